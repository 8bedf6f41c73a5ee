import re

from residuum.functions import constants as K
from residuum.operators import spectra


def test_pivot_makes_columns_from_counts(spark):
    rows = spark.createDataFrame([("p", "t", 3)] * 5 + [("p", "t", 95), ("p", "t", None), ("q", "t", None), (None, "t", 0)], "patient string, ttype string, channel int")
    wide = spectra.spectrum_pivot(rows)
    names = K.channels()
    got = {r.patient: {names.index(k): v for k, v in r.asDict().items() if k in names and v} for r in wide.collect()}
    assert got == {"p": {3: 5, 95: 1}, "q": {}, None: {0: 1}}
    assert all(r[n] is not None for r in wide.collect() for n in names)
    plan = wide._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Aggregate \[", plan)) == 2  # one by channel before the one with 96 columns
