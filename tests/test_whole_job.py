"""Registered queries and operators do the whole job: every row of the table takes part."""

import numpy as np
import pandas as pd

from spindrift.operators import basis as B
from spindrift.operators import regressors as R
from spindrift.operators import series as S
from spindrift.plans import registry


def test_event_design_holds_all_events(spark, data):
    """Against a plain design from every event's onset; operators must agree on coinciding and late onsets, too."""
    got = registry.QUERIES["event_regressors"](spark, data).toPandas()
    e = pd.read_parquet(f"{data}/events.parquet")
    since = (e["ts"] - pd.Timestamp("2024-01-01")).dt.floor("s").dt.total_seconds() / 3600
    n = int(since.max()) + 1
    at, first = np.linspace(0.5, n - 0.5, n), 0
    for name in sorted(e["event_type"].unique()):
        df = B.spline_df(1500, 0.01, 0.3)
        x = R.regressors(since[e["event_type"] == name].to_numpy(), at, B.basis_matrix(range(1500), df, "bs"))
        z = (x - x.mean(0)) / x.std(0)
        for k in range(df):
            mine = got[got["k"] == first + k].sort_values("t")["x"].to_numpy()
            assert np.allclose(mine, z[:, k], atol=1e-6)
        first += df
    assert got["k"].nunique() == first


def test_zscores_leave_rows_where_they_lie(spark, tmp_path):
    """Three groups of any size: their moments go to the rows, the rows aren't dealt out by group."""
    at = str(tmp_path / "rows.parquet")
    spark.range(3000, numPartitions=3).selectExpr("id", "id % 3 as g", "cast(id as double) as x").write.parquet(at)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (S.zscore_wide(spark.read.parquet(at), ["x"], ["g"]), S.zscore(spark.read.parquet(at), "x", ["g"])):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
            assert df.count() == 3000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
