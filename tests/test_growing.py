"""Scores of growing tables, and keys that a transformer invents."""

import pytest
from pyspark.sql import functions as F

from burnish.operators import batches, quality
from burnish.plans import growing


@pytest.fixture
def parts(spark):
    rows = spark.range(3000).selectExpr(
        "id % 700 AS a", "if(id % 11 = 0, ' Padded', if(id % 13 = 0, 'padded', concat('v', id % 40))) AS b",
        "if(id % 7 = 0, NULL, 'x') AS c",
    )
    return [rows.where(F.col("a") % 5 == i) for i in range(5)]


def test_only_new_files_are_read(spark, tmp_path, parts, monkeypatch):
    folder, store, seen = str(tmp_path / "t"), str(tmp_path / "s"), []

    def reader(paths):
        seen.append([p for p in paths if p.endswith(".parquet")])
        return spark.read.parquet(*paths)

    monkeypatch.setattr(growing, "MOST_BATCHES", 2)  # so that batches are put together on the way
    files = 0
    for part in parts:
        part.coalesce(2).write.mode("append").parquet(folder)
        seen.clear()
        got = growing.quality_score(spark, folder, store, reader).collect()
        assert got == quality.quality_score(spark.read.parquet(folder)).collect()
        now = len(list((tmp_path / "t").glob("*.parquet")))
        assert len(seen[0]) == now - files
        files = now
    seen.clear()
    assert growing.quality_score(spark, folder, store, reader).collect() == got and seen == [[]]
    assert len(list((tmp_path / "s").glob("manifest-*"))) <= 2


def test_gone_files_and_new_columns(spark, tmp_path, parts):
    folder, store = str(tmp_path / "t"), str(tmp_path / "s")
    for part in parts[:2]:
        part.coalesce(1).write.mode("append").parquet(folder)
        growing.quality_score(spark, folder, store).collect()
    next((tmp_path / "t").glob("*.parquet")).unlink()
    whole = quality.quality_score(spark.read.parquet(folder)).collect()
    assert growing.quality_score(spark, folder, store).collect() == whole
    with pytest.raises(ValueError, match="edge"):
        growing.quality_score(spark, folder, store, edge="leading")
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="no files"):
        growing.quality_score(spark, str(tmp_path / "none"), str(tmp_path / "other"))


def test_a_broken_update_changes_nothing(spark, tmp_path, parts):
    """Counts without a manifest do not count; the files are new the next time."""
    folder, store = str(tmp_path / "t"), str(tmp_path / "s")
    parts[0].write.parquet(folder)
    growing.quality_score(spark, folder, store).collect()
    parts[1].write.mode("append").parquet(folder)
    quality.record_counts(parts[1], ["b", "c"], "both").write.parquet(f"{store}/counts-left-over")
    (tmp_path / "s" / "manifest-000000000009").mkdir()
    assert growing.quality_score(spark, folder, store).collect() == quality.quality_score(spark.read.parquet(folder)).collect()


def test_invented_keys_stay(spark):
    """More keys than may become columns: the frequent ones do, the others stay with their rows."""
    extra = "map('often', string(id), if(id % 2 = 0, 'even', 'odd'), 'y', concat('k', id), 'own')"
    frame = spark.range(3000).selectExpr("id", f"if(id % 3 = 0, NULL, {extra}) AS _extra")
    wide = batches.extra_columns(frame, most=5)
    assert 5 <= len(wide.columns) <= 2 + 5 and {"_extra", "often", "even", "odd"} <= set(wide.columns)
    for row in wide.collect():
        told = {k: row[k] for k in wide.columns if k not in ("id", "_extra") and row[k] is not None} | (row._extra or {})
        want = {} if row.id % 3 == 0 else {"often": str(row.id), "even" if row.id % 2 == 0 else "odd": "y", f"k{row.id}": "own"}
        assert told == want
    few = batches.extra_columns(frame.selectExpr("id", "map_filter(_extra, (k, v) -> k IN ('often', 'odd')) AS _extra"), most=2)
    assert sorted(few.columns) == ["id", "odd", "often"]
