"""legajo: Spark-native analytics over document evidence.

Everything in this package is a pure ``DataFrame -> DataFrame`` function.  The
subpackages are

* ``functions``  - column expressions and small session helpers,
* ``operators``  - relational operators built from them,
* ``sources``    - readers and writers,
* ``streaming``  - Structured Streaming forms,
* ``plans``      - named queries and their SQL twins,
* ``llm``        - operators for training-text preparation; nothing outside it
  imports it.
"""
