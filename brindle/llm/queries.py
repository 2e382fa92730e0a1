"""Queries of this subpackage's operators over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import chat, clicks, exact_topk, fingerprints, html_text, mixing, near_dups, neighbours, packing, prefixes, quality, repeats, sharding
from brindle.llm.common import spread, table

WINDOW = 2048
SHARDS = 8


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), n_shards=SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize_documents(spread(table(spark, sf_dir, "documents")), tokenizer_path(), WINDOW)
    pieces = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    packed = packing.pack_pieces(pieces, WINDOW)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages, and lines too long to come twice by chance; repeated_lines takes lines of any length."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    shortened = repeats.remove_repeats(docs, passage_words=repeats.PASSAGE_WORDS, line_words=repeats.LINE_WORDS)
    return shortened.select("doc_id", "text", "removed", F.size("removed").alias("n_removed"))


def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4 by whole lines alone, in numbers that SQL can give too."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    shortened = repeats.remove_repeats(docs)
    chars = F.aggregate("removed", F.lit(0), lambda n, r: n + r["end"] - r["start"]).cast("long")
    first = F.coalesce(F.get("removed", 0)["start"], F.lit(-1))
    return shortened.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), F.size("removed").alias("n_removed"), chars.alias("chars_removed"), first.alias("first_start"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents")).drop("key").withColumn("target", F.round("target", 6))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    model = quality.train_quality(docs, table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, model).select("doc_id", quality.is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.similar_documents(spread(table(spark, sf_dir, "documents"))).drop("text_hash", "class_node")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(spread(table(spark, sf_dir, "documents")))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.extract_pages(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    read = chat.read_windows(chat.format_conversations(turns))
    # a digest over a conversation needs its texts in one place, where they are already, unless it is a long one
    lines = F.flatten(F.transform("windows", lambda w: F.transform(w["turns"], lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))))
    lost = F.array_join(F.flatten("windows.targets"), "")
    each = read.groupBy("place", "conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("window", "turns", "targets"))).alias("windows"), F.sum(F.length("formatted")).cast("long").alias("formatted_chars"))
    each = each.select("conv_id", "part", F.size(lines).cast("long").alias("n_turns"), F.array_join(lines, "").alias("lines"), lost.alias("lost"), "formatted_chars")
    if not chat.long_conversations(turns).isEmpty():
        joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", c))), lambda x: x[c]), "").alias(c)
        each = each.groupBy("conv_id").agg(F.sum("n_turns").alias("n_turns"), joined("lines"), joined("lost"), F.sum("formatted_chars").alias("formatted_chars"))
    return each.select(
        "conv_id", "n_turns", F.sha2("lines", 256).alias("turns_sha256"), F.length("lost").cast("long").alias("loss_chars"), F.sha2("lost", 256).alias("loss_sha256"), "formatted_chars"
    )


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op12_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv")
    return prefixes.prefix_trie(table(spark, sf_dir, "conversations"), conv - conv % 5, F.crc32(conv.cast("string")) % 9)


def op13_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clicks.deduplicate_clicks(table(spark, sf_dir, "clicks"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_neighbours": op2_neighbours,
        "op3_packing": op3_packing,
        "op4_repeats": op4_repeats,
        "op5_mixing": op5_mixing,
        "op6_quality": op6_quality,
        "op7_near_dups": op7_near_dups,
        "op8_fingerprints": op8_fingerprints,
        "op9_html": op9_html,
        "op10_chat": op10_chat,
        "op11_exact_topk": op11_exact_topk,
        "op12_prefixes": op12_prefixes,
        "op13_clicks": op13_clicks,
        "repeated_lines": repeated_lines,
    }


_OP5 = r"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5(concat_ws(':', '17', doc_id)) AS key FROM documents),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
 -- sources by how soon they reach their limit; the level is that of the first one that stays below it
 o AS (SELECT *, 3.0 * source_size / weight AS ratio, row_number() OVER (ORDER BY 3.0 * source_size / weight, source) AS k FROM s),
 l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3.0 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
 t AS (SELECT source, source_size, least(weight * (SELECT level FROM l WHERE level <= ratio ORDER BY k LIMIT 1), 3.0 * source_size) AS target FROM l),
 e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(round(target) / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
 p AS (SELECT doc_id, size, source, key, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d),
 q AS (SELECT doc_id, CAST(size AS BIGINT) AS size, p.source, source_size, target, epochs, CAST(greatest(0, least(size, round(target) - epochs * source_size - before)) AS BIGINT) AS part FROM p JOIN e ON p.source IS NOT DISTINCT FROM e.source)
 SELECT doc_id, size, source, source_size, round(CAST(target AS DOUBLE), 6) AS target, epochs, part, epochs * size + part AS taken FROM q"""

_OP10 = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
 p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos,
  12 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) + 1 + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 11 AS n FROM c),
 t AS (SELECT *, 4 + len(regexp_extract_all(role, '@')) + len(regexp_extract_all(text, '@')) AS tok FROM p),
 b AS (SELECT *, sum(tok) OVER w - tok AS before, sum(CAST(tok > 512 AS INT)) OVER w - CAST(tok > 512 AS INT) AS bigs FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
 k AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY bigs * 2 + CAST(tok > 512 AS INT), CASE WHEN tok > 512 THEN 0 ELSE before // 512 END) - 1 AS win FROM b),
 h AS (SELECT *, max(win) OVER (PARTITION BY conv_id) AS last, row_number() OVER (PARTITION BY conv_id, win ORDER BY pos DESC) AS back, sum(tok) OVER (PARTITION BY conv_id, win ORDER BY pos DESC) AS back_tok FROM k)
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) + sum(CASE WHEN pos = 0 AND role = 'system' THEN n * last WHEN win < last AND back <= 2 AND back_tok <= 256 THEN n ELSE 0 END) AS BIGINT) AS formatted_chars FROM h GROUP BY conv_id""".replace("@", chat.TOKEN)


_LINES = r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS k FROM documents),
 n AS (SELECT *, array_to_string(regexp_extract_all(lower(line), '[a-z0-9_\x{80}-\x{10FFFF}]+'), ' ') AS norm, k = max(k) OVER (PARTITION BY doc_id) AS ends FROM l),
 r AS (SELECT *, length(line) + CASE WHEN ends THEN 0 ELSE 1 END AS size, norm <> '' AND row_number() OVER (PARTITION BY norm ORDER BY doc_id, k) > 1 AS gone FROM n),
 p AS (SELECT *, sum(size) OVER (PARTITION BY doc_id ORDER BY k) - size AS start, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY k), false) AS gone_before FROM r)
 SELECT doc_id, md5(coalesce(string_agg(line || CASE WHEN ends THEN '' ELSE chr(10) END, '' ORDER BY k) FILTER (NOT gone), '')) AS text_md5, CAST(count(*) FILTER (gone AND NOT gone_before) AS INTEGER) AS n_removed,
  CAST(coalesce(sum(size) FILTER (gone), 0) AS BIGINT) AS chars_removed, CAST(coalesce(min(start) FILTER (gone), -1) AS INTEGER) AS first_start FROM p GROUP BY doc_id"""


_OP11 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS vec FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.vec, v.vec) AS BIGINT) AS score FROM v q JOIN v ON v.vec_id IS DISTINCT FROM q.vec_id AND q.vec_id % 100 = 0),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM s)
 SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""


def _crc32(text: str) -> str:
    """SQL for the CRC-32 of a text in ASCII: eight shifts for each character."""
    codes = f"list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT))"
    return f"xor(list_reduce({codes}, lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda p, q: xor(p >> 1, 3988292384 * (p & 1)))), 4294967295)"


_OP12 = f"""WITH t AS (SELECT conv_id AS c, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS said, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
 k AS (SELECT c, count(*) AS n, c - c % 5 AS s, {_crc32("c::VARCHAR")} % 9 AS h FROM t GROUP BY c),
 b AS (SELECT k.c, pos AS d, said FROM k JOIN t ON t.c = k.s AND pos <= h
  UNION ALL SELECT k.c, pos - k.h + least(k.h, coalesce(q.n, 0)), said FROM k JOIN t ON t.c = k.c AND pos > k.h LEFT JOIN k q ON q.c = k.s),
 w AS (SELECT k.c, coalesce(list(said ORDER BY d) FILTER (WHERE d IS NOT NULL), []) AS path FROM k LEFT JOIN b ON b.c = k.c GROUP BY k.c),
 p AS (SELECT c, path AS whole, unnest(range(0, len(path) + 1)) AS depth, path FROM w),
 n AS (SELECT path[:depth] AS node, depth, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE len(whole) = depth), '')) AS ends_sha256 FROM p GROUP BY ALL),
 l AS (SELECT node, CASE WHEN depth > 0 THEN (n_convs - 1) * strlen(node[depth].text) ELSE 0 END AS saved, node NOT IN (SELECT node[:depth - 1] FROM n WHERE depth > 0) AS leaf, unnest(range(0, depth + 1)) AS top, depth FROM n),
 u AS (SELECT node[:top] AS node, sum(saved) AS saved, count(*) FILTER (WHERE leaf) AS leaves, count(*) FILTER (WHERE depth = top + 1) AS children FROM l GROUP BY ALL)
 SELECT n.conv_id, n.depth, a.conv_id AS parent_conv_id, n.n_convs, u.children AS n_children, u.leaves AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, n.ends_sha256
 FROM n JOIN u ON u.node = n.node LEFT JOIN n a ON n.depth > 0 AND a.node = n.node[:n.depth - 1]"""


_OP13 = f"""WITH RECURSIVE j AS (SELECT *, epoch_us(arrived_at) AS arrived, unnest(range(0, (click_id % 3 + 3) % 3 + 1)) AS j FROM clicks WHERE click_id IS NOT NULL AND arrived_at IS NOT NULL),
 c AS (SELECT *, {_crc32("concat(click_id, ':', j)")} AS c FROM j),
 h AS (SELECT *, CAST(floor(arrived / 3600000000) AS BIGINT) + 6 * j * (c % 10) AS hour FROM c),
 l AS (SELECT click_id, hour, hour + c // 10 % 200 AS l, sha256(concat(coalesce(client_id::VARCHAR, ''), '|', coalesce(kind, ''), '|', coalesce(CAST(floor(100 * value + 0.5) AS BIGINT)::VARCHAR, ''), '|', coalesce(epoch_us(ts)::VARCHAR, ''), '|', coalesce(props, ''), '|', c % 3)) AS hash FROM h),
 b AS (SELECT *, (l - min(l) OVER ()) * 10 // (max(l) OVER () - min(l) OVER () + 1) AS batch FROM l),
 m AS (SELECT s.batch, max(hour) AS top FROM range(1, 11) s(batch) JOIN b ON b.batch < s.batch GROUP BY s.batch),
 e AS (SELECT click_id, batch, hour, hash, row_number() OVER (PARTITION BY click_id ORDER BY batch, hour, hash) AS k FROM b LEFT JOIN m USING (batch) WHERE top IS NULL OR hour >= top - 24),
 f AS (SELECT click_id, k, batch, hour, hash, hour AS start_hour, hash AS opener, k AS opened FROM e WHERE k = 1
  UNION ALL SELECT e.click_id, e.k, e.batch, e.hour, e.hash, CASE WHEN e.hour <= f.start_hour + 48 THEN f.start_hour ELSE e.hour END, CASE WHEN e.hour <= f.start_hour + 48 THEN f.opener ELSE e.hash END, CASE WHEN e.hour <= f.start_hour + 48 THEN f.opened ELSE e.k END
  FROM f JOIN e ON e.click_id = f.click_id AND e.k = f.k + 1),
 w AS (SELECT click_id, opened, start_hour, opener AS hash, max(k) AS last, count(*) - 1 AS n_repeats, count(*) FILTER (WHERE hash <> opener) AS n_conflicts, CAST(coalesce(sum({_crc32("hash")}) FILTER (WHERE hash <> opener), 0) AS BIGINT) AS conflict_crc FROM f GROUP BY ALL)
 SELECT w.click_id, start_hour, least(coalesce(e.batch, 9), coalesce((SELECT min(m.batch) - 1 FROM m WHERE w.start_hour + 48 < m.top - 24), 9)) AS closed_batch, n_repeats, n_conflicts, conflict_crc, w.hash
 FROM w LEFT JOIN e ON e.click_id = w.click_id AND e.k = w.last + 1"""


def oracle_sql() -> dict[str, str]:
    """The others are compared with brute force, round trips or held-out labels in tests."""
    return {"op5_mixing": _OP5, "op10_chat": _OP10, "op11_exact_topk": _OP11, "op12_prefixes": _OP12, "op13_clicks": _OP13, "repeated_lines": _LINES}
