"""Chunks and parents: ordered packing of block pieces by heading and size, sentence windows, size scans.

Input blocks: artifact, block_id, ord, type, text and optionally section_path, level, page, quality_score, caption,
code_language, image_uri. The packing state resets on what was packed, so it runs over one scope's pieces as a stream of sorted
rows (``fold.running``); everything about it is relational.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmere.functions.text import padded, token_len
from quillmere.operators.blocks import index_decision
from quillmere.operators.fold import running
from quillmere.params import ChunkParams

# Block types by their treatment.
ATOMIC = ["code", "formula", "table", "image"]
SPARSE = ["text", "list", "code", "formula", "table"]


def pieces(blocks: DataFrame, p: ChunkParams = ChunkParams()) -> DataFrame:
    """Blocks as pieces of at most ``chunk_tokens``, but atomic ones whole.

    A text over the budget is cut into its sentences, which are then packed in order; one sentence over the budget is cut
    into runs of words.
    """
    b = blocks.withColumn("tokens", token_len(F.col("text")))
    fits = F.col("type").isin(*ATOMIC, "heading") | (F.col("tokens") <= p.chunk_tokens)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end"), F.col("text").alias("piece"), F.col("tokens").alias("n")))
    # sentences with what follows them; a long one as words
    words = F.expr(r"flatten(transform(regexp_extract_all(text, '(?s).+?(?:[.!?。！？；]+[\\s]*|$)', 0), s -> if(regexp_count(s, '[\\p{L}\\p{N}]+|[^\\s\\p{L}\\p{N}]') > " + str(p.chunk_tokens) + r", regexp_extract_all(s, '(?s)\\s*\\S+\\s*', 0), array(s))))")
    state = "struct(array(struct(0 as start, 0 as end, '' as piece, 0L as n)) as done, struct(0 as start, 0 as end, '' as piece, 0L as n) as open)"
    b = b.withColumn("__s", F.when(fits, F.array().cast("array<string>")).otherwise(words))
    fold = F.expr(
        f"""aggregate(transform(__s, s -> struct(s as s, cast(regexp_count(s, '[\\\\p{{L}}\\\\p{{N}}]+|[^\\\\s\\\\p{{L}}\\\\p{{N}}]') as bigint) as n)), {state}, (acc, x) ->
        if(acc.open.n > 0 and acc.open.n + x.n > {p.chunk_tokens},
           struct(concat(acc.done, array(acc.open)) as done, struct(acc.open.end as start, acc.open.end + length(x.s) as end, x.s as piece, x.n as n) as open),
           struct(acc.done as done, struct(acc.open.start as start, acc.open.end + length(x.s) as end, concat(acc.open.piece, x.s) as piece, acc.open.n + x.n as n) as open)),
        acc -> slice(concat(acc.done, array(acc.open)), 2, size(acc.done)))"""
    )
    cut = F.when(fits, whole).otherwise(fold)
    kept = [c for c in blocks.columns if c not in ("text",)]
    out = b.select(*kept, "text", F.posexplode(cut).alias("part", "x"))
    return out.select(*kept, F.col("part"), F.col("x.start").alias("start"), F.col("x.end").alias("end"), F.col("x.piece").alias("text"), F.col("x.n").alias("n"), (F.col("type").isin(*ATOMIC) & (F.col("x.n") > p.chunk_tokens)).alias("oversized"))


def scope_of(blocks: DataFrame, fallback: str = "(start)") -> DataFrame:
    """Adds ``scope``: a heading's path with itself, else the path, else the title or ``fallback``."""
    path = F.col("section_path") if "section_path" in blocks.columns else F.array().cast("array<string>")
    title = F.col("title") if "title" in blocks.columns else F.lit(None).cast("string")
    own = F.when(F.col("type") == "heading", F.concat(path, F.array("text"))).otherwise(path)
    return blocks.withColumn("scope", F.when(F.size(own) > 0, F.array_join(own, " > ")).otherwise(F.coalesce(F.nullif(title, F.lit("")), F.lit(fallback))))


def pack(piece_rows: DataFrame, p: ChunkParams = ChunkParams()) -> DataFrame:
    """Adds ``grp`` (scope in order of first appearance) and ``pack`` (chunk within the scope, from 0).

    A heading after a body closes; else what does not fit closes; an oversized atomic piece closes at once.
    """
    budget = p.chunk_tokens

    def step(state, n, heading, oversized, place):
        _, grp, at, tokens, held, body = state
        grp = place if grp is None else grp
        if held and ((heading and body) or tokens + n > budget):
            at, tokens, held, body = at + 1, 0, 0, False
        if oversized:
            return at, grp, at + 1, 0, 0, False
        return at, grp, at, tokens + n, held + 1, body or not heading

    # pieces are made once: their columns pass through the stream, where a scope's first row tells its place
    rows = piece_rows.withColumn("__h", F.col("type") == "heading")
    own = ["artifact", "scope", "ord", "part"]
    packed = running(rows, own[:2], own[2:], ["n", "__h", "oversized", "ord"], step, (0, None, 0, 0, 0, False), ["pack", "grp"], [c for c in piece_rows.columns if c not in own])
    return packed.withColumn("pack", F.col("pack").cast("int")).withColumn("grp", F.col("grp").cast(piece_rows.schema["ord"].dataType))


def pack_in_place(piece_rows: DataFrame, p: ChunkParams = ChunkParams()) -> DataFrame:
    """``pack`` whose stream sees places and sizes only; what it tells goes back to the pieces by artifact.

    Texts of rows that are dealt by artifact already (as ``clean_blocks`` leaves them) stay where they are; pieces are made twice for it.
    """
    own = ["artifact", "scope", "ord", "part"]
    piece_rows = piece_rows.where(F.col("artifact").isNotNull())  # as the join has it; said here, both readings of the pieces are one to Spark
    told = pack(piece_rows.select(*own, "type", "n", "oversized"), p).select(*own, "grp", "pack")
    return piece_rows.join(told.repartition("artifact"), own)


def _rendered(have: set[str], p: ChunkParams):
    """A piece's part of its chunk's text."""
    col = lambda c, t: F.col(c) if c in have else F.lit(None).cast(t)
    level = F.greatest(F.lit(1), F.least(F.coalesce(col("level", "int"), F.lit(1)), F.lit(6)))
    caption = F.coalesce(col("caption", "string"), F.col("text"))
    heading = F.lit("") if p.strip_headings else F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.col("text"))
    return (
        F.when(F.col("type") == "heading", heading)
        .when(F.col("type") == "code", F.concat(F.lit("```"), F.coalesce(col("code_language", "string"), F.lit("")), F.lit("\n"), F.col("text"), F.lit("\n```")))
        .when(F.col("type") == "formula", F.concat(F.lit("$$"), F.col("text"), F.lit("$$")))
        .when(F.col("type") == "image", F.concat(F.lit("!["), caption, F.lit("]("), F.coalesce(col("image_uri", "string"), F.lit("")), F.lit(")")))
        .otherwise(F.col("text"))
    )


def chunk_tokens(blocks: DataFrame, p: ChunkParams = ChunkParams()) -> DataFrame:
    """(artifact, scope, pack, token_count) of the same chunks as ``chunks`` gives, without their texts."""
    made = pieces(scope_of(blocks), p)
    filled = F.trim(F.coalesce(_rendered(set(made.columns), p), F.lit(""))) != ""
    packed = pack(made.select("artifact", "scope", "ord", "part", "type", "n", "oversized", filled.alias("filled")), p)
    return packed.groupBy("artifact", "scope", "pack").agg(F.sum("n").cast("long").alias("token_count"), F.bool_or("filled").alias("filled")).where("filled").drop("filled")


def chunks(blocks: DataFrame, p: ChunkParams = ChunkParams(), in_place: bool = False) -> DataFrame:
    """Chunks of all artifacts: ids, text, sparse text, fragments, pages, headings, quality and index decision; ``in_place`` packs by ``pack_in_place``."""
    packed = (pack_in_place if in_place else pack)(pieces(scope_of(blocks), p), p)
    have = set(packed.columns)
    col = lambda c, t: F.col(c) if c in have else F.lit(None).cast(t)
    caption = F.coalesce(col("caption", "string"), F.col("text"))
    rendered = _rendered(have, p)
    sparse = F.when(F.col("type").isin(*SPARSE), F.col("text")).when(F.col("type") == "image", F.nullif(caption, F.lit("")))
    path = F.col("section_path") if "section_path" in have else F.array().cast("array<string>")
    row = F.struct(
        "ord", "part", F.col("block_id") if "block_id" in have else F.col("ord").cast("string").alias("block_id"), F.col("type").alias("block_type"), "text", "start", "end", "n", "oversized", col("page", "int").alias("page"),
        rendered.alias("rendered"), sparse.alias("sparse"), path.alias("path"), F.coalesce(col("quality_score", "double"), F.lit(1.0)).alias("q"),
    )
    built = packed.groupBy("artifact", "scope", "grp", "pack").agg(F.sort_array(F.collect_list(row)).alias("ps"))
    joined = lambda field, sep: F.array_join(F.filter(F.transform("ps", lambda x: x[field]), lambda t: F.trim(F.coalesce(t, F.lit(""))) != ""), sep)
    built = built.withColumn("full_text", joined("rendered", "\n\n")).withColumn("sparse_text", joined("sparse", "\n"))
    if p.carry_heading:  # headings of a chunk that has nothing else belong to the next one of the scope
        w = Window.partitionBy("artifact", "scope").orderBy("pack")
        alone = F.when(F.col("full_text") == "", F.filter("ps", lambda x: x["block_type"] == "heading"))
        built = built.withColumn("carried", F.coalesce(F.lag(alone).over(w), F.array().cast(built.schema["ps"].dataType)))
    else:
        built = built.withColumn("carried", F.array().cast(built.schema["ps"].dataType))
    built = built.where("full_text <> ''")
    heads = F.filter(F.concat("carried", "ps"), lambda x: x["block_type"] == "heading")
    pages = F.filter(F.transform("ps", lambda x: x["page"]), lambda x: x.isNotNull())
    weight = F.aggregate("ps", F.lit(0).cast("bigint"), lambda s, x: s + F.greatest(x["n"], F.lit(1)))
    score = F.aggregate("ps", F.lit(0.0), lambda s, x: s + x["q"] * F.greatest(x["n"], F.lit(1))) / weight
    number = F.row_number().over(Window.partitionBy("artifact").orderBy("grp", "pack"))
    last = F.element_at(heads, -1)
    out = built.withColumn("heads", heads).withColumn("number", number).select(
        F.concat_ws("", F.col("artifact").cast("string"), F.lit("_c"), padded(F.col("number"))).alias("chunk_id"),
        "artifact", "scope", "grp", "pack", "number", "full_text", "sparse_text",
        F.aggregate("ps", F.lit(0).cast("bigint"), lambda s, x: s + x["n"]).alias("token_count"),
        F.aggregate("ps", F.lit(0).cast("bigint"), lambda s, x: s + F.length(x["text"])).alias("char_count"),
        F.array_min(pages).alias("page_start"), F.array_max(pages).alias("page_end"),
        F.when(F.size("heads") > 0, F.concat(F.element_at("heads", -1)["path"], F.array(F.element_at("heads", -1)["text"]))).otherwise(F.element_at("ps", 1)["path"]).alias("section_path"),
        F.when(F.size("heads") > 0, F.element_at("heads", -1)["block_id"]).alias("section_block_id"),
        F.transform("heads", lambda x: x["text"]).alias("headings"),
        F.transform("ps", lambda x: F.struct(x["block_id"].alias("block_id"), x["block_type"].alias("block_type"), x["start"].alias("start_char"), x["end"].alias("end_char"), x["text"].alias("text"), x["page"].alias("page"))).alias("fragments"),
        F.when(F.exists("ps", lambda x: x["oversized"]), F.array(F.lit("oversized_atomic_block"))).otherwise(F.array().cast("array<string>")).alias("flags"),
        score.alias("quality_score"),
    )
    status = F.when(F.col("quality_score") >= 0.85, "high").when(F.col("quality_score") >= 0.6, "medium").otherwise("low")
    return out.withColumn("quality_status", status).withColumn("index_decision", index_decision(F.col("quality_status"))).withColumn("quality_score", F.round("quality_score", 4))


def parents(chunk_rows: DataFrame, p: ChunkParams = ChunkParams()) -> DataFrame:
    """(parent_id, artifact, scope_title, child_chunk_ids, full_text, token_count, pages): a scope's chunks in order, at most parent_tokens together."""
    cap = p.parent_tokens if p.parent_tokens > 0 else (1 << 62)

    def step(state, n):
        at, total, held = state
        return (at + 1, n, 1) if held and total + n > cap else (at, total + n, held + 1)

    seg = running(chunk_rows, ["artifact", "scope"], ["pack"], ["token_count"], step, (0, 0, 0), "seg")
    rows = chunk_rows.join(seg.withColumn("seg", F.col("seg").cast("int")), ["artifact", "scope", "pack"])
    grouped = rows.groupBy("artifact", F.col("scope").alias("scope_title"), "grp", "seg").agg(
        F.sort_array(F.collect_list(F.struct("pack", "chunk_id", "full_text"))).alias("cs"), F.sum("token_count").alias("token_count"),
        F.min(F.when(F.col("page_start") > 0, F.col("page_start"))).alias("page_start"), F.max(F.when(F.col("page_end") > 0, F.col("page_end"))).alias("page_end"),
    )
    number = F.row_number().over(Window.partitionBy("artifact").orderBy("grp", "seg"))
    return grouped.withColumn("number", number).select(
        F.concat_ws("", F.col("artifact").cast("string"), F.lit("_p"), padded(F.col("number"))).alias("parent_id"), "artifact", "scope_title",
        F.transform("cs", lambda x: x["chunk_id"]).alias("child_chunk_ids"), F.array_join(F.transform("cs", lambda x: x["full_text"]), "\n\n").alias("full_text"), "token_count", "page_start", "page_end",
    )


def invariant_breaks(chunk_rows: DataFrame, blocks: DataFrame, p: ChunkParams = ChunkParams()) -> DataFrame:
    """(chunk_id, problem): fragments that differ from their block's text, and chunks over budget that are no single oversized piece. Must be empty."""
    frags = chunk_rows.select("chunk_id", "artifact", "token_count", F.size("fragments").alias("n"), F.explode("fragments").alias("f"))
    src = blocks.select("artifact", (F.col("block_id") if "block_id" in blocks.columns else F.col("ord").cast("string")).alias("block_id"), F.col("text").alias("source"))
    wrong = frags.join(src, (frags.artifact == src.artifact) & (F.col("f.block_id") == src.block_id)).where(F.expr("substring(source, f.start_char + 1, f.end_char - f.start_char) <> f.text")).select("chunk_id", F.lit("fragment differs").alias("problem"))
    over = chunk_rows.where((F.col("token_count") > p.chunk_tokens) & (F.size("fragments") > 1)).select("chunk_id", F.lit("over budget").alias("problem"))
    return wrong.unionByName(over)


def chunk_problems(chunk_rows: DataFrame, blocks: DataFrame, p: ChunkParams = ChunkParams()) -> DataFrame:
    """(artifact, chunk_id, problem): every chunk once, with the first of its breaks by name or null.

    Chunks and blocks meet by artifact and block, so that rows that are dealt by artifact stay; a fragment of no block differs too.
    """
    frags = chunk_rows.select("chunk_id", "artifact", (F.col("token_count") > p.chunk_tokens).alias("over"), F.size("fragments").alias("n"), F.explode_outer("fragments").alias("f"))
    frags = frags.select("chunk_id", "artifact", "over", "n", F.col("f.block_id").alias("block_id"), F.col("f.start_char").alias("start"), F.col("f.end_char").alias("end"), F.col("f.text").alias("piece"))
    src = blocks.select("artifact", (F.col("block_id") if "block_id" in blocks.columns else F.col("ord").cast("string")).alias("block_id"), F.col("text").alias("source"))
    differs = ~F.coalesce(F.expr("substring(source, start + 1, end - start) = piece"), F.lit(False))
    found = F.when(differs, "fragment differs").when(F.col("over") & (F.col("n") > 1), "over budget")
    return frags.join(src, ["artifact", "block_id"], "left").withColumn("problem", found).groupBy("artifact", "chunk_id").agg(F.min("problem").alias("problem"))


def size_scan(blocks: DataFrame, sizes: list[int]) -> DataFrame:
    """Per chunk size: chunks, tokens, mean, median, greatest and share at 98 % of the size or more; and the change of the mean to the size before."""
    parts = []
    for s in sizes:
        c = chunk_tokens(blocks, ChunkParams(chunk_tokens=s)).select(F.lit(s).alias("size"), "token_count")
        parts.append(c)
    rows = parts[0]
    for q in parts[1:]:
        rows = rows.unionByName(q)
    agg = rows.groupBy("size").agg(
        F.count("*").alias("n_chunks"), F.sum("token_count").alias("tokens"), F.round(F.avg("token_count"), 4).alias("mean"), F.percentile("token_count", F.lit(0.5)).alias("median"),
        F.max("token_count").alias("greatest"), F.round(F.avg((F.col("token_count") >= 0.98 * F.col("size")).cast("double")), 4).alias("full_share"),
    )
    return agg.withColumn("slope", F.round(F.col("mean") / F.lag("mean").over(Window.orderBy("size")) - 1.0, 4))


def plateaus(scan: DataFrame, most: float = 0.02) -> DataFrame:
    """(size_from, size, change, first) of neighbouring sizes of a scan whose numbers of chunks differ by less than ``most``; ``first`` is where the first such stretch begins."""
    w = Window.orderBy("size")  # a row for each size
    change = F.round(F.col("n_chunks") / F.lag("n_chunks").over(w) - 1.0, 4)
    flat = scan.select(F.lag("size").over(w).alias("size_from"), "size", change.alias("change")).where(F.abs("change") < most)
    return flat.withColumn("first", F.min("size_from").over(Window.partitionBy()))


def sentence_windows(sents: DataFrame, group: str, order: str, text: str, radius: int) -> DataFrame:
    """Adds ``window``: each sentence with ``radius`` neighbours on both sides of its group."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(-radius, radius)
    return sents.withColumn("window", F.array_join(F.collect_list(text).over(w), " "))


def metadata_prefixes(sents: DataFrame, group: str, order: str, heading: str, per_page: int = 14) -> DataFrame:
    """Adds ``prefix``: the last heading so far, and a page of ``per_page`` sentences."""
    w = Window.partitionBy(group).orderBy(order)
    page = F.floor((F.row_number().over(w) - 1) / per_page) + 1
    return sents.withColumn("prefix", F.concat_ws(" | ", F.last(heading, True).over(w), F.concat(F.lit("p."), page.cast("string"))))


def cut_points(sents: DataFrame, group: str, order: str, text: str, distance: str, max_chars: int, back: int) -> DataFrame:
    """(group, chunk, first, last): length first; each cut at the greatest distance within the last ``back`` characters.

    The next start hangs on the last cut, so an Arrow function walks the groups' rows in order; it holds the lengths of one
    chunk and of one batch, never a group or its texts.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    kind = sents.schema[group].dataType
    schema = f"{group} {kind.simpleString()}, chunk int, first long, last long"
    names = [group, "chunk", "first", "last"]

    def run(batches):
        out: list[tuple] = []
        pos, size, dist = [], [], []
        key, chunk, start = None, 0, 0

        def cut(to_end):
            """Cuts what is known: all that is left, if the group ends, else as long as there is more than a chunk."""
            nonlocal chunk, start
            while start < len(pos):
                total, end = 0, start
                while end < len(pos) and (end == start or total + size[end] <= max_chars):
                    total += size[end]
                    end += 1
                if end == len(pos) and not to_end:
                    return
                at = end
                if end < len(pos):
                    room, k, best = 0, end - 1, -1.0
                    while k > start and room <= back:
                        if dist[k] > best:
                            best, at = dist[k], k + 1
                        room += size[k]
                        k -= 1
                out.append((key, chunk, pos[start], pos[at - 1]))
                chunk, start = chunk + 1, at

        def batch():
            cols = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], to_arrow_type(kind)), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=names)

        for b in batches:
            for g, o, n, d in zip(*(b.column(k).to_pylist() for k in range(4))):
                if pos and g != key:
                    cut(True)
                    pos, size, dist, chunk, start = [], [], [], 0, 0
                key = g
                pos.append(o)
                size.append(n)
                dist.append(d)
            cut(False)
            pos, size, dist, start = pos[start:], size[start:], dist[start:], 0
            if out:
                yield batch()
        cut(True)
        if out:
            yield batch()

    rows = sents.select(group, F.col(order).cast("long").alias("__o"), F.coalesce(F.length(text), F.lit(0)).alias("__n"), F.coalesce(F.col(distance).cast("double"), F.lit(0.0)).alias("__d"))
    return rows.repartition(group).sortWithinPartitions(group, "__o").mapInArrow(run, schema)
