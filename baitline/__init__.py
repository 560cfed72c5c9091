"""baitline: headline-quality data preparation, encoding and evaluation on Spark.

Subpackages:

* ``functions`` - column expressions (tokens, packing, masks, text metrics)
* ``operators`` - DataFrame operators (prepare, split, encode, evaluate, report,
  row positions, scorers)
* ``sources``   - inputs derived from the driver tables, dataset/report sinks
* ``plans``     - end-to-end plans, user jobs, registered queries, SQL oracle
* ``streaming`` - the per-row stages on file streams
"""

__version__ = "0.1.0"
