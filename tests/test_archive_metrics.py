"""Member metrics: distinct counts apart from sums, with members of no file."""

from faktum.operators.archive import member_metrics

DDL = "file_id long, ord long, path string, size_bytes long, compressed_bytes long, entry_type string, method string, mode long, mtime_unix long, crc32 long, encrypted boolean, extra_bytes long, comment_bytes long"


def test_distinct_counts_carry_no_sums(spark):
    row = lambda f, k, path, crc, at: (f, k, path, 5, 5, "file", "stored", None, at, crc, False, 0, 0)
    members = spark.createDataFrame([row(f, k, f"p{k % 3}", k % 2, k % 4 or None) for f in (1, 2, None) for k in range(8)] + [row(3, 0, None, None, None)], DDL)
    found = member_metrics(members)
    got = {r.file_id: (r.member_count, r.duplicate_member_count, r.crc_collision_count, r.mtime_unique_count, r.mtime_unique_ratio) for r in found.collect()}
    assert got == {f: (8, 5, 6, 3, 0.5) for f in (1, 2, None)} | {3: (1, 0, 0, 0, None)}
    # a row that is made for a distinct value has its key, the value and a number, not all columns
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    expands = [x for x in plan.splitlines() if "Expand" in x]
    assert expands and all("is_hidden" not in x and "mode" not in x for x in expands)
