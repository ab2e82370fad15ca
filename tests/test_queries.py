import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__
from specula.plans import registry
from tests.oracle import same

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, name):
    same(__spark_entry__.queries()[name](spark, data), SQL[name], data)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, data, name):
    assert __spark_entry__.queries()[name](spark, data).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_query_with_sql_is_registered():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_flagship_labels_of_videos_whose_mean_is_50(spark, data, tmp_path):
    """The SQL adds doubles up frame by frame (on one thread), and their last bits decide; the videos' events lie in several files."""
    for name in os.listdir(data):
        if name != "events.parquet":
            os.symlink(f"{data}/{name}", tmp_path / name)
    r, videos, each = np.random.default_rng(5), 400, 60
    cents = r.integers(0, 20000, (videos, each))
    cents[:, -1] += 5000 * each - cents.sum(1)
    cents[:, :-1] += cents[:, -1:] // each  # brings the last one near the others
    cents[:, -1] += 5000 * each - cents.sum(1)
    assert (cents.sum(1) == 5000 * each).all()
    value, n = (cents / 100).T.ravel(), videos * each
    kinds = np.array(["view", "click", "purchase", "error", "signup"])[r.integers(0, 5, n)]
    ts = pa.array(np.datetime64("2024-01-01", "us") + np.arange(n))
    events = pa.table({"event_id": np.arange(n), "ts": ts, "user_id": np.tile(np.arange(videos), each), "event_type": kinds, "value": value, "props": [""] * n})
    (tmp_path / "events.parquet").mkdir()
    for k in range(8):
        pq.write_table(events.slice(k * n // 8, n // 8), tmp_path / "events.parquet" / f"{k}.parquet")
    found = __spark_entry__.queries()["flagship"](spark, str(tmp_path))
    assert {x["label"] for x in found.collect()} == {"Fake", "Real"}
    same(found, "SET threads = 1; " + SQL["flagship"], str(tmp_path))
