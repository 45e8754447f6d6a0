"""Queries of the corpus operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, labels


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import encode_png, read_png

    return read_png(encode_png(documents(spark, sf_dir))).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "status")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import classify

    return classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op3_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import compare_with_edits

    return compare_with_edits(documents(spark, sf_dir))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import BASE_KINDS, find_pii

    found = find_pii(documents(spark, sf_dir))
    mark = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    of_kind = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(k)).cast("bigint").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(F.array_join(F.transform(base, mark), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", mark), ",").alias("spans"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..runtime import reliable_checkpoint
    from .mixing import apply_mix, plan_mix, with_draws

    drawn = reliable_checkpoint(with_draws(documents(spark, sf_dir)).drop("row"))
    facts, small = plan_mix(drawn)
    return apply_mix(drawn, facts, small).select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import digests

    return digests(documents(spark, sf_dir)).drop("ids")


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shards import shard_documents

    dealt = shard_documents(documents(spark, sf_dir))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    found = scan_licenses(documents(spark, sf_dir))
    mark = lambda m: F.concat_ws(":", m["license"], m["start"], m["end"])
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["coverage"])), F.lit(0.0))
    return found.select("doc_id", F.size("matches").cast("bigint").alias("n_matches"), best.alias("best_coverage"), F.array_join(F.transform("matches", mark), ",").alias("spans"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_media, op2_toxicity, op3_merkle, op4_pii, op5_mixing, op6_bpe, op7_shards, op8_licenses, op9_simhash, op10_language)}

_TREE = """[[[sha256(x) for x in regexp_extract_all(p, '[^.!?]{1,64}[.!?]*\\s*|[.!?]+\\s*')] for p in regexp_extract_all(s, '[^\\n]*\\n|[^\\n]+')]
    for s in string_split(replace(TEXT, chr(10) || chr(10), chr(10) || chr(10) || chr(1)), chr(1)) if s <> '']"""

ORACLES: dict[str, str] = {
    # Texts hold no character 1, which stands for the ends of sections here.
    "op3_merkle": f"""
        with d as (select doc_id, coalesce(text, '') t from documents),
        n as (select *, coalesce(lead(t) over (order by doc_id desc nulls last, t), first(t) over (order by doc_id desc nulls last, t)) nxt from d),
        e as (select *, substr(t, 1, length(t) - length(t) // 3) || substr(nxt, 1, length(t) // 3) ed from n),
        leaf as (select *, {_TREE.replace('TEXT', 't')} lt, {_TREE.replace('TEXT', 'ed')} le, {_TREE.replace('TEXT', 'nxt')} ln from e),
        node as (select *, [[sha256(array_to_string(p, '')) for p in s] for s in lt] nt, [[sha256(array_to_string(p, '')) for p in s] for s in le] ne,
            list_distinct(flatten(flatten(lt))) a, list_distinct(flatten(flatten(le))) b, list_distinct(flatten(flatten(ln))) c from leaf),
        sect as (select *, [sha256(array_to_string(s, '')) for s in nt] st, [sha256(array_to_string(s, '')) for s in ne] se from node)
        select doc_id, cast(length(t) as bigint) n_chars, sha256(ed) edited_sha256,
            sha256(array_to_string(st, '')) fingerprint,
            sha256(array_to_string(se, '')) edited_fingerprint,
            case when len(a) + len(b) = 0 then 1.0 else 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) end near_edited,
            case when len(a) + len(c) = 0 then 1.0 else 2.0 * len(list_intersect(a, c)) / (len(a) + len(c)) end near_next,
            cast(len(flatten(nt)) as int) n_paragraphs, cast(len(a) as int) n_leaves,
            array_to_string([i - 1 for i in generate_series(1, greatest(len(st), len(se))) if st[i] is distinct from se[i]], ',') edited_sections,
            array_to_string([i - 1 for i in generate_series(1, greatest(len(flatten(nt)), len(flatten(ne)))) if flatten(nt)[i] is distinct from flatten(ne)[i]], ',') edited_paragraphs
        from sect""",
    "op5_mixing": """
        with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) size,
                (cast('0x' || substr(md5('42:' || doc_id), 1, 12) as bigint) + 0.5) / 281474976710656.0 u from documents),
        s0 as (select source, cast(sum(size) as bigint) source_size, cast([5, 2, 1][1 + (row_number() over (order by source nulls last) - 1) % 3] as double) w from d group by source),
        s1 as (select *, cast(source_size * 3 as double) cap from s0),
        s2 as (select *, (sum(cast(source_size as double)) over () - coalesce(sum(cap) over o, 0)) / (sum(w) over () - coalesce(sum(w) over o, 0)) lev
            from s1 window o as (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding)),
        s3 as (select source, source_size, round(least(cap, w * max(lev) over ()), 6) target from s2),
        s4 as (select *, case when source_size > 0 then cast(least(floor(target / source_size), 3) as bigint) else 0 end base from s3),
        s5 as (select *, case when base < 3 then greatest(target - base * source_size, 0) else 0 end remaining from s4),
        z as (select d.source, size, count(*) n, any_value(remaining) remaining from d join s5 on d.source is not distinct from s5.source where size > 0 and remaining > 0 group by d.source, size),
        k as (select *, coalesce(sum(n) over larger, 0) n0, coalesce(sum(n * size) over larger, 0) w0, sum(n * size) over every w1, coalesce(sum(n * size * size) over larger, 0) q0, sum(n * size * size) over every q1 from z
            window larger as (partition by source order by size desc rows between unbounded preceding and 1 preceding), every as (partition by source)),
        k2 as (select *, (remaining - cast(w0 as double)) / cast(q1 - q0 as double) rate from k),
        s6 as (select source, rate, cast(round(cast(n0 as double) + rate * cast(w1 - w0 as double)) as bigint) wanted from k2 where rate * size <= 1 qualify row_number() over (partition by source order by size desc) = 1),
        r as (select d.*, s5.* exclude (source), s6.wanted, rate * size p from d join s5 on d.source is not distinct from s5.source left join s6 on d.source is not distinct from s6.source),
        r2 as (select *, case when p >= 1 then 0 when p > 0 then (u / (1 - u)) / (p / (1 - p)) end q from r),
        f as (select *, q is not null and row_number() over (partition by source, q is null order by q, doc_id) <= wanted inside from r2),
        g as (select source, max(remaining) - coalesce(sum(size) filter (where inside), 0) missing from f group by source),
        b as (select f.source, f.q, f.doc_id, f.inside, f.size, g.missing, f.wanted,
            row_number() over (partition by f.source, f.inside order by case when f.inside then -f.q else f.q end, case when f.inside then -f.doc_id else f.doc_id end) n
            from f join g on f.source is not distinct from g.source where f.q > 0 and f.wanted > 0),
        near as (select source, any_value(missing) missing, list({'size': size, 'q': q, 'id': doc_id} order by size, q, doc_id) filter (where inside) i, list({'size': size, 'q': q, 'id': doc_id} order by size, q, doc_id) filter (where not inside) o
            from b where n <= greatest(2, least(24, ceil(wanted / 2.0))) group by source having count(*) filter (where inside) > 0 and count(*) filter (where not inside) > 0),
        n1 as (select source, missing, case when missing < 0 then list_reverse(i) else i end x, case when missing < 0 then o else list_reverse(o) end y from near),
        n2 as (select *, [y[j].size - x[j].size for j in range(1, least(len(x), len(y)) + 1)] gains from n1),
        n3 as (select *, list_sort([{'gap': abs(missing - coalesce(list_sum(gains[1:k]), 0)), 'k': k, 'words': coalesce(list_sum(gains[1:k]), 0)} for k in range(0, len(gains) + 1)])[1] many from n2),
        n4 as (select source, many.k k, missing - many.words missing, x, y from n3),
        n5 as (select *, list_sort(flatten([[{'gap': abs(missing - (v.size - u.size)), 'q1': u.q, 'i1': u.id, 'q2': v.q, 'i2': v.id} for v in y[k + 1:]] for u in x[k + 1:]]))[1] pair from n4),
        a as (select source, list_concat([{'q': z.q, 'id': z.id} for z in list_concat(x[1:k], y[1:k])], case when pair.gap < abs(missing) then [{'q': pair.q1, 'id': pair.i1}, {'q': pair.q2, 'id': pair.i2}] else [] end) trade from n5)
        select f.doc_id, f.size, f.source_size, f.target, cast((f.base + case when f.inside <> coalesce(list_contains(a.trade, {'q': f.q, 'id': f.doc_id}), false) then 1 else 0 end) * f.size as bigint) taken
        from f left join a on f.source is not distinct from a.source""",
}
