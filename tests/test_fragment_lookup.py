"""Whole passages, not their first lines, are looked up in chunks."""

from quillmere.plans import catalogue


def test_whole_passages_are_looked_up(spark, tmp_path):
    lead = "The quick harvest of barley began early."
    rest = "Then every wagon rolled slowly down to the mill."
    docs = [
        (1, f"Some opening line of the report stands here.\n{lead}\n{rest}\nAnd a closing line of it follows here."),
        (2, f"{lead}\nBut another story goes on from here, with nothing else in common."),
        (3, "Was and. This document holds an eight character line and no passage at all."),
    ]
    items = [(10, f"{lead}\n{rest}"), (11, f"Thing.\n{lead}"), (12, "Was and.\nNo document has this second line."), (13, "Tiny."), (14, None), (15, f"stands here.\n{lead}  {rest}")]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = catalogue.QUERIES["q_fragment_lookup"](spark, str(tmp_path)).collect()
    found = {r.item_id: r.chunk_id for r in out if r.chunk_id is not None}
    assert set(found) == {10, 15} and found[10] == found[15]
    assert {r.item_id: r.problem for r in out if r.chunk_id is None} == {11: "in no chunk", 12: "in no chunk", 13: "under 8 characters", 14: "under 8 characters"}
    assert len(out) == len(items)
