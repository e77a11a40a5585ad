"""The queries of this subpackage, each over its whole table, and their SQL where it can be said in SQL."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fim, flac, license, merkle, minhash, mixing, packing, pii, quality, subspace, suffix, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of ``documents``: five-word shingles, similarity 0.75."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of ``documents`` that no repeated string of 400 bytes covers; also the passages (250 bytes or more) that stand elsewhere too."""
    found = suffix.passages_and_repeats(_table(spark, sf_dir, "documents"))

    def total(spans: str) -> Column:
        return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])

    passages = F.coalesce(F.size("passages"), F.lit(0)).cast("long"), F.coalesce(total("passages"), F.lit(0).cast("long"))
    return found.select(
        "doc_id", "n_bytes", total("spans").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), passages[0].alias("n_passages"), passages[1].alias("n_passage_bytes")
    )


def op3_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of ``documents`` stored as FLAC and read back."""
    found = flac.load(flac.store(_table(spark, sf_dir, "documents")))
    feature = F.concat_ws(";", *(F.concat(F.lit(f"{x}="), F.col(f"features.{x}")) for x in ("sum", "energy", "crossings", "peak")), F.concat(F.lit("blocks="), F.size("offsets")))
    return found.select("doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def _joined(spans: str) -> Column:
    """kind:start:end of an array of spans."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in ``documents``: the plain identifiers are counted and digested, ``spans`` holds disguised ones too."""
    found = pii.find(_table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def op5_subspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of ``embeddings``: cosine 0.9 or more."""
    return subspace.near_vectors(_table(spark, sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length buckets and batches of ``documents``."""
    return packing.bucket_batches(_table(spark, sf_dir, "documents"))


def op7_patience_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in ``documents``."""
    found = license.licenses(_table(spark, sf_dir, "documents"))
    shown = F.transform("notices", lambda x: F.concat_ws(":", x["license"], x["start"], x["end"], F.format_number(x["coverage"], 4)))
    return found.select("doc_id", F.size("notices").cast("long").alias("n_notices"), F.array_join(shown, ",").alias("notices"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of ``documents`` by a public vocabulary, and the texts that they decode to."""
    import public_tokenizers

    found = bpe.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    ids = F.sha2(F.array_join("ids", " ").cast("binary"), 256)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of ``documents``, learnt from ``labels``."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op10_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of ``documents``, learnt from ``labels``."""
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of ``documents`` in fill-in-middle order, and the texts rebuilt from the outputs."""
    found = fim.transform(_table(spark, sf_dir, "documents"))
    digests = F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(fim.restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256")
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of ``documents``; some rows are folded after tampering."""
    docs = _table(spark, sf_dir, "documents")
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    tampered = F.when(hit, merkle.leaf([lowered if f == "text" else F.col(f) for f in merkle.FIELDS]))
    found = merkle.manifest(docs, also={"tampered": tampered})
    folded = merkle.folded(F.coalesce("tampered", "leaf"), F.col("proof")).alias("folded_root")
    told = found.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")).cast("binary"), 256).alias("proof_sha256"), folded)
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each of ``documents`` is taken into a mix of its sources."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_minhash": op1_minhash, "op2_suffix_array": op2_suffix_array, "op3_flac": op3_flac, "op4_pii": op4_pii, "op5_subspace": op5_subspace, "op6_packing": op6_packing, "op7_patience_license": op7_patience_license, "op8_byte_bpe": op8_byte_bpe, "op9_weak_toxicity": op9_weak_toxicity, "op10_gam": op10_gam, "op11_fim": op11_fim, "op12_merkle": op12_merkle, "op13_mixing": op13_mixing}
#: Components of links (a, b in both directions) over nodes (id), for small tables.
_REACH = """
reach as (select id, id as root from nodes union select l.b, r.root from reach r join links l on l.a = r.id),
found as (select id, min(root) as component_id from reach group by id)
"""
#: Unsigned crc32 of an ASCII string, bit by bit.
_CRC32 = "xor(list_reduce(list_concat([4294967295], list_transform(range(8 * length({0})), lambda k: (ascii(substr({0}, k // 8 + 1, 1)) >> (k % 8)) & 1)), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"
ORACLE_SQL: dict[str, str] = {
    "op1_minhash": rf"""
with recursive w as (select doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
nodes as (select id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from w),
g as (select id, len(s) as n, unnest(s) as g from nodes),
links as (select x.id as a, y.id as b from g x join g y on x.g = y.g and x.id <> y.id group by all having 100 * count(*) >= 75 * (max(x.n) + max(y.n) - count(*))),
{_REACH}
select id as doc_id, cast(len(s) as bigint) as n_shingles, component_id, component_id = id as kept from nodes join found using (id)""",
    "op5_subspace": f"""
with recursive nodes as (select vec_id as id, cast(embedding as double[]) as v from embeddings),
links as (select x.id as a, y.id as b from nodes x join nodes y on x.id <> y.id and list_cosine_similarity(x.v, y.v) >= 0.9),
{_REACH}
select id as vec_id, (select count(*) from links where a = id) as n_links, component_id, component_id = id as kept from nodes join found using (id)""",
    "op11_fim": rf"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as u, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
c as (select *, len(u) as n, list_transform([0, 1, 2, 3], lambda i: cast('0x' || substr(h, 8 * i + 1, 8) as bigint)) as r from d),
f as (select *, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or r[3] % 100 >= 100 then 'plain' when r[4] % 100 < 50 then 'spm' else 'psm' end as form,
    least(r[1] % (n + 1), r[2] % (n + 1)) as a, greatest(r[1] % (n + 1), r[2] % (n + 1)) as b from c),
p as (select *, coalesce(array_to_string(u[1:a], ''), '') as pre, coalesce(array_to_string(u[a + 1:b], ''), '') as mid, coalesce(array_to_string(u[b + 1:], ''), '') as suf from f)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(length(pre) as bigint) end as prefix_chars, case when form <> 'plain' then cast(length(mid) as bigint) end as middle_chars,
    sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(t) as restored_sha256
from p""",
    "op12_merkle": rf"""
with recursive d as (select *, row_number() over () as row from documents),
framed as (select doc_id, source, row, c, list_transform([cast(doc_id as varchar), source, lang, cast(n_chars as varchar), case when c then translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}') else text end],
    lambda v: coalesce(strlen(v) || ':' || v, '-')) as v from d, (values (false), (true)) t(c)),
digests as (select doc_id, source, row, max(h) filter (not c) as h, max(h) filter (c) as lowered from (select *, sha256(array_to_string(v, '')) as h from framed) group by all),
placed as (select *, row_number() over (partition by source order by doc_id nulls first, h) - 1 as i, count(*) over (partition by source) as n from digests),
tree as (select 0 as level, source, i, n, h from placed
    union all select level + 1, source, i // 16, (n + 15) // 16, sha256(string_agg(h, '' order by i)) from tree where n > 1 group by level, source, i // 16, (n + 15) // 16),
subroots as (select source, h, row_number() over (order by source nulls first) - 1 as i, count(*) over () as n from tree where n = 1),
crown as (select 0 as level, i, n, h from subroots union all select level + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' order by i)) from crown where n > 1 group by level, i // 16, (n + 15) // 16),
runs as (select level, source, i // 16 as p, list(h order by i) as run from tree where n > 1 group by all union all select level + 100, null, i // 16, list(h order by i) from crown where n > 1 group by all),
fold as (
    select 0 as level, row, placed.source, placed.i, placed.n, subroots.i as j, subroots.n as m, '' as proof,
        case when {_CRC32.format('cast(doc_id as varchar)')} % 5 = 0 then lowered else placed.h end as h from placed join subroots on placed.source is not distinct from subroots.source
    union all
    select case when f.n > 1 then f.level + 1 when f.level < 100 then 101 else f.level + 1 end, row, f.source, case when f.n > 1 then i // 16 else j // 16 end, case when f.n > 1 then (n + 15) // 16 else n end,
        case when f.n > 1 then j else j // 16 end, case when f.n > 1 then m else (m + 15) // 16 end,
        proof || array_to_string(run[1:x], '') || array_to_string(run[x + 2:], ''), sha256(array_to_string(run[1:x], '') || h || array_to_string(run[x + 2:], ''))
    from (select *, cast(case when n > 1 then i else j end as bigint) % 16 as x from fold where n > 1 or m > 1) f join runs r
        on case when f.n > 1 then f.level when f.level < 100 then 100 else f.level end = r.level and case when f.n > 1 then f.source end is not distinct from r.source and case when f.n > 1 then i // 16 else j // 16 end = r.p)
select doc_id, placed.h as leaf, subroots.h as subroot, root, sha256(proof) as proof_sha256, fold.h as folded_root, fold.h = root as verified
from fold join placed using (row) join subroots on placed.source is not distinct from subroots.source, (select h as root from crown where n = 1) where fold.n = 1 and fold.m = 1""",
}
