"""Pieces are packed in one stream, and scans of sizes count the chunks without their texts."""

from quillmere.operators import chunk as ch
from quillmere.params import ChunkParams

ROWS = [(a, o, str(o), k, t, None if k != "heading" else 1) for a in (1, 2) for o, (k, t) in enumerate([
    ("heading", "Top"), ("text", "One two three. " * 9), ("code", "x = 1\n" * 30), ("heading", "Next"), ("heading", "Lone"), ("text", " "), ("text", "Four five six seven."), ("image", ""), ("text", "Tail words. " * (4 * a)),
])]


def test_same_chunks_without_texts_and_no_join_to_pack(spark):
    blocks = spark.createDataFrame(ROWS, "artifact long, ord int, block_id string, type string, text string, level int")
    for size in (5, 20, 200):
        p = ChunkParams(chunk_tokens=size)
        want = sorted((r.artifact, r.scope, r.pack, r.token_count) for r in ch.chunks(blocks, p).collect())
        assert sorted(map(tuple, ch.chunk_tokens(blocks, p).collect())) == want and want
    packed = ch.pack(ch.pieces(ch.scope_of(blocks), ChunkParams(chunk_tokens=20)), ChunkParams(chunk_tokens=20))
    assert "Join" not in packed._jdf.queryExecution().executedPlan().toString()
    assert packed.schema["grp"].dataType == packed.schema["ord"].dataType
