"""creditlens — loan-default analytics as Spark DataFrame operators.

Every operator takes Spark DataFrames and returns a lazy DataFrame; nothing
row-level passes through the driver.  Sub-packages:

* ``sources``   — table loading, CSV/Parquet readers and sinks, fixture views
* ``functions`` — column-level recodes (null-aware maps, clips, parses, bins)
* ``operators`` — dataset operators: profiling, segments, population study,
                  feature preparation, statistical tests, models, evaluation,
                  tree explanations, scalable prefix sums
* ``plans``     — the query registry and the DuckDB oracle texts
* ``streaming`` — file-stream forms of the counting and scoring jobs
"""

__version__ = "0.1.0"
