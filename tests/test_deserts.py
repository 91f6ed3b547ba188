"""Deserts from sums that are kept, against one run over all rows."""

import numpy as np

from clinicweave.operators import extraction


def test_batches_add_up_and_removed_rows_go(spark):
    rng = np.random.default_rng(0)
    rows = [(i, ["800001", "226001", "", None, "110001"][i % 5], ["Bihar", None, "Goa"][i % 3], int(rng.integers(0, 100)) if i % 7 else None, *(int(x) for x in rng.integers(0, 2, 4)), float(rng.normal()) if i % 4 else None, 75.0) for i in range(90)]
    df = spark.createDataFrame(rows, "i int, pin_code string, state string, trust_score int, has_icu int, has_dialysis int, has_emergency int, has_surgery int, latitude double, longitude double")
    plain = lambda d: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in d.collect()), key=repr)
    want = plain(extraction.pin_deserts(df.where("i % 10 <> 3 and i <> 4")))
    first, second = extraction.desert_sums(df.where("i < 40")), extraction.desert_sums(df.where("i >= 40"))
    gone = extraction.desert_sums(df.where("i % 10 = 3 or i = 4"), sign=-1)
    assert plain(extraction.deserts_of(extraction.merge_sums(first, second, gone))) == want
    only = extraction.merge_sums(extraction.desert_sums(df.where("i = 0")), extraction.desert_sums(df.where("i = 0"), sign=-1))
    assert only.count() == 0 and extraction.deserts_of(extraction.desert_sums(df.where("false"))).count() == 0
