"""fieldzones: soil-sampling design, interpolation and management zones as Spark jobs.

Every table carries ``codigo`` (the field code) and every operator runs over all fields
in one DataFrame plan.  Sub-packages:

* ``functions`` - column expressions (text rules, rounding, geometry, coordinate systems)
* ``sources``   - readers, writers and file discovery
* ``operators`` - the relational and statistical operators
* ``plans``     - end-to-end jobs composed from the operators
* ``streaming`` - (empty: the workload has no streaming part)
"""

__version__ = "0.1.0"
