"""Registered queries of the operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.llm import decontaminate, imatch, language, licenses, merkle, mixing, ngram_join, search, secrets, simhash, suffixes, tokens, warc
from panelspark.llm.common import checkpoint, shared_folder


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def op1_licenses(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan(_table(spark, folder, "documents"))
    listed = F.transform("spans", lambda s: F.concat_ws(":", F.concat_ws("-", s["first_line"], s["last_line"]), s["family"], F.round(s["probability"], 3)))
    return found.select("doc_id", "n_paragraphs", "n_licences", F.array_join("families", ",").alias("families"), F.array_join(listed, ",").alias("spans"))


def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffixes.removed(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    named = docs.select("doc_id", "text", language.held_out().alias("held_out"))
    return language.identify(named, language.learned_from(docs), ["doc_id", "held_out"])


def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    members, place = warc.archive(_table(spark, folder, "pages"))
    return warc.read(members, place, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, folder, "documents"), ["doc_id"])
    counts = [secrets.counted("base_spans", k).alias(f"n_{secrets.KINDS[k]}") for k in range(3)]
    return found.select("doc_id", *counts, F.sha2(secrets.listed("base_spans"), 256).alias("base_sha256"), secrets.listed("spans").alias("spans"))


def op7_imatch(spark: SparkSession, folder: str) -> DataFrame:
    found = imatch.edited(_table(spark, folder, "documents"))
    prints = [imatch.hexadecimal(c).alias(c) for c in ("fingerprint", "edited_fingerprint")]
    return found.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), *prints, "near_edited", "near_next")


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Load all documents, try the load again, delete the toxic ones, revise those of low quality with white space collapsed."""
    docs = _table(spark, folder, "documents")
    marks = _table(spark, folder, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    counts = checkpoint(tokens.counted(docs, ["doc_id", "source", "lang"]))
    rollup = tokens.Rollup(spark, shared_folder(spark, "rollup"))
    rollup.commit("load", tokens.inserts(counts))
    rollup.commit("load", tokens.inserts(counts))
    rollup.commit("toxic", tokens.deletes(counts.join(marks.where("toxic = 1"), "doc_id", "left_semi")))
    low = marks.where("quality = 0 and coalesce(toxic, 0) <> 1")
    # Counted where the texts lie, so that only counts are shuffled to meet the labels.
    collapsed = docs.withColumn("text", F.regexp_replace("text", r"\s+", " "))
    after = checkpoint(tokens.counted(collapsed, ["doc_id", "source", "lang"]))
    rollup.commit("revise", tokens.revisions(counts.join(low, "doc_id", "left_semi"), after.join(low, "doc_id", "left_semi")))
    return rollup.totals()


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    plan = mixing.mix(_table(spark, folder, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "copies", "taken")


def op11_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op12_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every leaf's proof folded again, after the texts of half of the documents have lost their newlines."""
    without_lines = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    found = merkle.manifest(_table(spark, folder, "documents"), merkle.tampered(), without_lines)
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.linked(_table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_licenses, op2_suffix_dedup, op3_simhash, op4_language, op5_warc, op6_secrets, op7_imatch, op8_decontamination, op9_token_counts, op10_mixing, op11_search, op12_manifest, op13_ngram_join)
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"


def _shingles(table: str, key: str) -> str:
    """Distinct 5-word shingles per row; a shorter text has one of all its words."""
    return f"""select distinct row, {key}, words_n, array_to_string(w[i:i + least(5, words_n) - 1], ' ') as gram
    from (select row, {key}, w, len(w) as words_n, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i
          from (select row_number() over () as row, {key}, {_WORDS} as w from {table}) where len(w) > 0)"""


#: Levels of the trees of the manifest's SQL, which has one step for each: trees of up to 3**12 leaves.
_LEVELS = 12


def _tree_levels(key: str, first: int) -> list[str]:
    """Steps from a (the nodes of a level) and f (each leaf's fold and proof so far), numbered `first`, to those _LEVELS on.

    A node that is alone in its tree stays as it is.
    """
    out = []
    for k in range(first, first + _LEVELS):
        run = f"string_agg(node, '' order by pos) over (partition by {key}, pos // 3 order by pos rows between"
        up = "case when total > 1 then pos // 3 else pos end"
        out += [
            f"""s{k} as materialized (select *, coalesce({run} unbounded preceding and 1 preceding), '') as l,
  coalesce({run} 1 following and unbounded following), '') as r from a{k})""",
            f"""a{k + 1} as materialized (select {key}, {up} as pos, case when total > 1 then sha256(string_agg(node, '' order by pos)) else any_value(node) end as node,
  (total + 2) // 3 as total from a{k} group by {key}, {up}, total)""",
            f"""f{k + 1} as materialized (select f.* exclude (fold, place, proof), case when s.total > 1 then sha256(s.l || f.fold || s.r) else f.fold end as fold,
  case when s.total > 1 then f.place // 3 else f.place end as place, case when s.total > 1 then f.proof || s.l || s.r else f.proof end as proof
  from f{k} f join s{k} s on f.{key} is not distinct from s.{key} and f.place = s.pos)""",
        ]
    return out


def _manifest_sql() -> str:
    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(f"coalesce(octet_length(encode(cast({c} as varchar))) || ':' || cast({c} as varchar), '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    # CRC-32 of the decimal id, bit by bit; its lowest bit tells whether 2 divides it.
    bits = "list_reduce(range(8), lambda b, i: case when b & 1 = 1 then xor(b >> 1, 3988292384) else b >> 1 end, xor(c, ch))"
    crc = f"xor(list_reduce(list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ord(x) as bigint)), lambda c, ch: {bits}, cast(4294967295 as bigint)), 4294967295)"
    base, top = _LEVELS + 1, 2 * _LEVELS + 1
    steps = [
        f"d as (select *, case when {crc} & 1 = 0 then replace(text, chr(10), '') else text end as altered from documents)",
        f"h as (select doc_id, source, {leaf('text')} as leaf, {leaf('altered')} as now from d)",
        "n as materialized (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by source) as total from h)",
        "a0 as materialized (select source, pos, leaf as node, total from n)",
        "f0 as materialized (select doc_id, source, leaf, now as fold, pos as place, '' as proof from n)",
        *_tree_levels("source", 0),
        f"b as materialized (select source, node as subroot, row_number() over (order by source nulls first) - 1 as pos, count(*) over () as total from a{_LEVELS})",
        f"a{base} as materialized (select 1 as one, pos, subroot as node, total from b)",
        f"f{base} as materialized (select f.* exclude (place), b.pos as place, b.subroot, 1 as one from f{_LEVELS} f join b on f.source is not distinct from b.source)",
        *_tree_levels("one", base),
    ]
    root = f"(select node from a{top})"
    return "with " + ",\n".join(steps) + f"\nselect doc_id, leaf, subroot, {root} as root, sha256(proof) as proof_sha256, fold as folded_root, fold = {root} as verified from f{top}"


ORACLES: dict[str, str] = {
    "op5_warc": """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) || '00' as hex from pages),
d as (select page_id, cast(payload_bytes as bigint) as payload_bytes,
        array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((cast('0x' || substr(hex, 1 + (5 * i) // 4, 3) as integer) >> (7 - (5 * i) % 4)) & 31), 1) for i in range(32)], '') as payload_digest from p)
select page_id, payload_bytes, payload_digest,
  case when page_id = min(page_id) over (partition by payload_digest) then 'response' else 'revisit' end as record_type,
  case when page_id = min(page_id) over (partition by payload_digest) then null else min(page_id) over (partition by payload_digest) end as refers_to
from d""",
    "op8_decontamination": f"""
with items as ({_shingles('benchmark', 'item_id')}),
sizes as (select row, count(*) as shingles from items group by row),
docs as (select row, doc_id, w from (select row_number() over () as row, doc_id, {_WORDS} as w from documents)),
grams as (
  select distinct d.row, d.doc_id, n.width, array_to_string(d.w[i:i + n.width - 1], ' ') as gram
  from (select row, doc_id, w, width, unnest(range(1, len(w) - width + 2)) as i
        from docs, (select distinct least(5, words_n) as width from items) where len(w) >= width) d,
       (select distinct least(5, words_n) as width from items) n where n.width = d.width)
select g.doc_id, i.item_id, cast(count(*) as bigint) as shared, cast(any_value(s.shingles) as bigint) as shingles,
       count(*) / cast(any_value(s.shingles) as double) as containment
from items i join grams g on g.gram = i.gram and g.width = least(5, i.words_n) join sizes s on s.row = i.row
group by i.row, i.item_id, g.row, g.doc_id
having count(*) >= 0.8 * any_value(s.shingles) - 1e-9""",
    "op10_mixing": r"""
with d as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
             (cast('0x' || substr(md5('7:' || coalesce(cast(doc_id as varchar), 'null')), 1, 12) as bigint) + 0.5::double) / 281474976710656.0::double as u
           from documents),
z as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, [5, 2, 1][1 + (row_number() over (order by source nulls last) - 1) % 3] as weight from z),
f as (select *, sum(source_size) over () - 3 * coalesce(sum(source_size) over (order by source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as rest,
        sum(weight) over (order by source_size / weight, source nulls last rows between current row and unbounded following) as open from w),
c as (select *, 3 * source_size * open <= rest * weight as capped from f),
l as (select arg_min(rest, source_size / weight) as rest, arg_min(open, source_size / weight) as open from c where not capped),
t as (select c.source, c.source_size, case when c.capped then c.source_size * 3.0::double else cast(l.rest as double) * c.weight / cast(l.open as double) end as target from c cross join l),
r as (select d.*, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0.0::double end as ratio from d join t on d.source is not distinct from t.source),
e as (select *, cast(floor(ratio) as bigint) as whole, target - floor(ratio) * source_size as extra from r),
q as (select *, case when source_size > 0 then extra / source_size else 0.0::double end as share from e),
o as (select *, case when share <= 0 then 1e18::double when share < 1 then u / (1 - u) / (share / (1 - share)) else u / (1 - u) / 1e18::double end as rank from q),
o0 as (select *, false as more, extra as goal from o),
a1 as (select *, not more and size > 0 and size <= goal as fits from o0),
b1 as (select * exclude (more), more or coalesce(fits and sum(case when fits then size end) over (partition by source order by rank, doc_id, size rows unbounded preceding) <= goal, false) as more from a1),
o1 as (select * exclude (goal, fits), goal - coalesce(sum(case when more and fits then size end) over (partition by source), 0) as goal from b1),
a2 as (select *, not more and size > 0 and size <= goal as fits from o1),
b2 as (select * exclude (more), more or coalesce(fits and sum(case when fits then size end) over (partition by source order by rank, doc_id, size rows unbounded preceding) <= goal, false) as more from a2),
o2 as (select * exclude (goal, fits), goal - coalesce(sum(case when more and fits then size end) over (partition by source), 0) as goal from b2),
a3 as (select *, not more and size > 0 and size <= goal as fits from o2),
b3 as (select * exclude (more), more or coalesce(fits and sum(case when fits then size end) over (partition by source order by rank, doc_id, size rows unbounded preceding) <= goal, false) as more from a3),
o3 as (select * exclude (goal, fits), goal - coalesce(sum(case when more and fits then size end) over (partition by source), 0) as goal from b3),
n as (select *, row_number() over (partition by source order by more or size = 0 or abs(goal - size) >= goal, abs(goal - size), rank, doc_id) = 1 and not more and size > 0 and abs(goal - size) < goal as filler from o3),
k as (select *, whole + case when more or filler then 1 else 0 end as copies from n)
select doc_id, size, source_size, target, copies, copies * size as taken from k""",
    "op11_search": rf"""
with d as (select row_number() over () as row, doc_id, regexp_extract_all({_LOWER}, '{_TERM}') as w from documents),
i as (select row_number() over () as row, item_id, regexp_extract_all({_LOWER}, '{_TERM}') as w from benchmark),
c as (select cast(count(*) as bigint) as docs, cast(sum(len(w)) as bigint) as length from d where len(w) > 0),
q as (select distinct row, item_id, unnest(w) as term from i),
t as (select row, doc_id, n, term, count(*) as tf from (select row, doc_id, len(w) as n, unnest(w) as term from d) where term in (select term from q) group by all),
g as (select term, cast(floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1))) as bigint) as w from t, c group by term),
s as (select q.row, q.item_id, t.row as doc, t.doc_id, cast(sum(g.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (10 + (90 * t.n * c.docs) // c.length)))) as bigint) as score
      from q join t using (term) join g using (term), c group by all having score > 0),
r as (select *, row_number() over (partition by row order by score desc, doc_id nulls last, doc) as rank from s)
select item_id, cast(rank as int) as rank, doc_id, score from r where rank <= 10""",
    "op12_manifest": _manifest_sql(),
    "op13_ngram_join": rf"""
with recursive d as (select row_number() over () as row, doc_id, {_WORDS} as w from documents),
s as materialized (select distinct row, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') as gram from (select row, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from d where len(w) > 0)),
z as materialized (select row, count(*) as size from s group by row),
l as materialized (select a.row as x, b.row as y from s a join s b on a.gram = b.gram and a.row <> b.row join z p on p.row = a.row join z q on q.row = b.row
      group by a.row, b.row, p.size, q.size having 100 * count(*) >= 85 * (p.size + q.size - count(*))),
reach as (select row, row as other from d union select r.row, l.y from reach r join l on l.x = r.other),
m as (select r.row, min(o.doc_id) as component_id from reach r join d o on o.row = r.other group by r.row)
select d.doc_id, cast(coalesce(z.size, 0) as bigint) as n_shingles, m.component_id from d join m on m.row = d.row left join z on z.row = d.row""",
}
