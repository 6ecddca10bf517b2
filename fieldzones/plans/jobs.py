"""End-to-end jobs over all fields at once: the three workflows of the toolset.

Each job takes DataFrames (or table paths) and writes its outputs partitioned by field;
nothing is collected except small per-field results inside the iterative operators.

* :func:`sampling_design_job` - grid, layer features, quota, K-means, sample points and
  the population-vs-sample comparison.
* :func:`zoning_job` - lab join, forests, prediction, variogram/kriging, PCA, Moran's I,
  fuzzy C-means, zone raster and dissolved zones.
* :func:`zone_report_job` - zonal statistics, the soil report and the dosage template.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldzones.operators import (dosage, fcm, field_forest, lattice, moran, raster, samples, sampling,
                                  spatial, stats, zonal)
from fieldzones.session import cut_lineage, join_small
from fieldzones.plans.zoning import ZONING_VARS
from fieldzones.sources import io

@dataclass
class SamplingDesign:
    features: DataFrame
    quotas: DataFrame
    samples: DataFrame
    comparison: DataFrame


def sampling_design_job(field_vertices: DataFrame, pixels: DataFrame, meta: DataFrame,
                        ha_per_point: float, cellsize: float = 10.0, inset: float = 11.0,
                        out: str | None = None) -> SamplingDesign:
    """Sampling design for every field (the first workflow)."""
    fields = spatial.build_polygons(field_vertices)
    layers = sorted(r[0] for r in meta.select("layer").distinct().collect())  # layer names only
    grid = spatial.eroded_grid(fields, cellsize, inset)
    feat = cut_lineage(raster.sample_layers(grid, pixels, meta, layers))
    quotas = sampling.sampling_quota(spatial.polygon_area(fields), ha_per_point)
    assigned, centres = sampling.spatial_kmeans(feat, quotas.select("codigo", F.col("n_puntos").alias("k")))
    reps = sampling.number_samples(sampling.representatives(assigned, centres))
    smp = feat.join(reps.select("codigo", "pid", "n"), ["codigo", "pid"])
    idx = [c for c in layers if c.startswith(("EVI", "NDVI"))]
    comparison = sampling.representativeness(feat, smp, idx)
    if out:
        io.write_csv(feat, f"{out}/features")
        io.write_layer(smp, f"{out}/samples")
    return SamplingDesign(feat, quotas, smp, comparison)


@dataclass
class Zoning:
    grid: DataFrame
    importances: DataFrame
    kriged: DataFrame
    moran: DataFrame
    fits: DataFrame
    zones: DataFrame
    zone_raster: DataFrame
    dissolved: DataFrame


def zoning_job(features: DataFrame, sample_points: DataFrame, lab: DataFrame,
               fields: DataFrame, c: int | None = None, num_trees: int = 1500,
               radius: float = 50.0, max_lag: float | None = None, n_lags: int = 6,
               out: str | None = None) -> Zoning:
    """Interpolation and management zones for every field (the second workflow).

    Each field has its own forests, so a field without laboratory results has no zones.
    ``c`` = number of zones; None picks the c of greatest fuzzy partition coefficient.
    """
    grid = samples.standardise_layers(features)
    train = samples.join_lab(samples.standardise_layers(sample_points), lab)
    preds = samples.predictor_columns(train.columns)
    have, _ = samples.present(train.columns, samples.SOIL_VARIABLES)
    forests = field_forest.fit(train, have, preds, num_trees)
    imp = forests.importances
    predicted = field_forest.predict(grid, forests).groupBy("codigo", "pid").agg(
        *[F.max(F.when(F.col("variable") == v, F.col("value"))).alias(v) for v in have])
    grid = cut_lineage(grid.drop(*have).join(predicted, ["codigo", "pid"]))
    long = sampling.unpivot(grid, have, keys=("codigo", "pid", "x", "y"), name="variable")
    long = cut_lineage(long.filter(F.col("value").isNotNull()))
    meta = raster.grid_meta(grid).withColumn("layer", F.lit("kriged"))
    blocks = lattice.lattice_blocks(long, extent=meta)
    model = cut_lineage(lattice.fit_weighted(lattice.lattice_variogram(blocks, n_lags, max_dist=max_lag)))
    cells = lattice.krige_lattice(lattice.solve_lattice(blocks, model)).withColumn("layer", F.lit("kriged"))
    kriged = spatial.pixels_in_polygons(cells, fields, meta)
    zv = [v for v in ZONING_VARS if v in grid.columns]
    z = cut_lineage(stats.standardise(stats.impute_mean(grid, zv), zv))
    fit = stats.pca_fit(z, zv)
    scores = cut_lineage(stats.pca_transform(z, fit, zv, 3))
    pcs = [c for c in ("PC1", "PC2", "PC3") if c in scores.columns]
    mi = moran.morans_i_permuted(scores, pcs, radius)
    fits, memb = fcm.fuzzy_cmeans(scores, pcs, cs=(2, 3, 4, 5) if c is None else (c,))
    memb = join_small(memb, fcm.choose_c(fits), ["codigo", "n_clusters"], "left_semi")
    zones = scores.select("codigo", "pid", "x", "y").join(memb.select("codigo", "pid", "u", "Cluster"),
                                                          ["codigo", "pid"])
    zr = raster.rasterise_zones(zones)
    dis = raster.dissolve_zones(zones)
    if out:
        io.write_layer(grid, f"{out}/grid_pred")
        io.write_layer(kriged, f"{out}/nutrientes")
        io.write_layer(zr, f"{out}/zonas_raster")
    return Zoning(grid, imp, kriged, mi, fits, zones, zr, dis)


def zone_report_job(zone_vertices: DataFrame, pixels: DataFrame, layers: list[str],
                    meta: DataFrame | None = None, dose_name: str | None = None,
                    out: str | None = None):
    """Zone statistics, the per-zone soil report and the dosage template (third workflow).

    With the raster ``meta`` pixel containment is the scanline equi-join; without it the
    pixels need ``x, y`` centres.
    """
    zones = spatial.build_polygons(zone_vertices, keys=("codigo", "Zonas"))
    layer = zonal.zone_statistics(zones, pixels, layers, meta)
    report = zonal.zone_report(layer)
    dose = dosage.dosage_layer(layer, dose_name) if dose_name else None
    if out:
        io.write_layer(layer.drop("parts"), f"{out}/zonas")  # never over the input layer
        io.write_layer(report, f"{out}/reporte")
        if dose is not None:
            io.write_layer(dose, f"{out}/dosificacion")
    return layer, report, dose
