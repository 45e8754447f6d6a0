"""DuckDB SQL of the queries, built from named subqueries; clustering steps are unrolled."""

from __future__ import annotations

from .queries import BATCH, CHECK_QUERIES, CHUNK, COSTS, GRID, GROUP_STEPS, GROUPS, MULTI_K, MULTI_STEPS, SEED, SELECTED, SHARDS, STEPS, TOP_B, TOP_K, TOPICS

DIM = 64

#: Named subqueries, each over those before it.
PARTS: dict[str, str] = {
    "docs": "select cast(vec_id as varchar) doc_id, vec_id pos, cast(embedding as double[]) v, cast(label as bigint) topic from embeddings",
    "queries": "select doc_id query_id, v from docs where pos % 25 = 0",
    "qrels": """
        select cast(q.vec_id as varchar) query_id, cast(d.vec_id as varchar) doc_id,
               cast(case when q.vec_id = 25 then 0 else (d.vec_id * 31 + q.vec_id * 17) % 5 end as int) rel
        from embeddings q join embeddings d on q.label = d.label and q.vec_id <> d.vec_id
        where q.vec_id % 25 = 0 and q.vec_id not in (50, 75) and (d.vec_id * 31 + q.vec_id * 17) % 5 <= 2
        union all select cast(vec_id as varchar), 'missing-' || cast(vec_id as varchar), 1 from embeddings where vec_id % 100 = 0 or vec_id = 50
        union all select '999999', '1', 1""",
    "pos": "select distinct query_id, doc_id from qrels where rel > 0",
    "corpus": "select cast(doc_id as varchar) doc_id, source title, text from documents",
    "texts": "select cast(conv_id as varchar) query_id, text from conversations where turn = 0 and role = 'user'",
    "raw_qrels": "select cast(doc_id % 10 as varchar) query_id, cast(doc_id as varchar) doc_id, quality rel from labels",
    "places": f"select cast(unnest(generate_series(1, {DIM})) as int) i",
    "random_shards": f"select doc_id, pos, v, row_number() over (order by md5('{SEED}:' || doc_id), doc_id) - 1 ord, (row_number() over (order by md5('{SEED}:' || doc_id), doc_id) - 1) % {SHARDS} shard_id from docs",
}


def unit(source: str, keys: str, vector: str = "v") -> str:
    """Normalised vectors; a zero vector stays as it is."""
    return f"""
        select {keys}, list(x order by i) v from (
            select {keys}, i, {vector}[i] / case when list_dot_product({vector}, {vector}) > 0 then sqrt(list_dot_product({vector}, {vector})) else 1 end x
            from {source}, places) group by {keys}"""


def means(source: str, keys: str, vector: str = "v") -> str:
    return f"select {keys}, list(x order by i) v from (select {keys}, i, avg({vector}[i]) x from {source}, places group by {keys}, i) group by {keys}"


def lloyd(name: str, source: str, key: str, k: int, steps: int, group: str | None = None) -> dict[str, str]:
    """Parts <name>_c (group, cid, v) and <name>_a (key, group, cid): centres and assignment after so many steps."""
    g, part = group or "0", f"partition by {group} " if group else ""
    order = f"md5('{SEED}:' || cast({key} as varchar)), {key}"
    parts = {f"{name}_r": f"select {key} key, {g} g, v from {source}"}
    parts[f"{name}_c0"] = f"select g, cid, v from (select {g} g, row_number() over ({part}order by {order}) - 1 cid, v from {source}) where cid < {k}"
    for t in range(steps + 1):
        last = t == steps
        parts[f"{name}_a" if last else f"{name}_a{t}"] = f"select r.key, r.g, (list(c.cid order by list_distance(r.v, c.v), c.cid))[1] cid from {name}_r r join {name}_c{t} c on r.g = c.g group by r.key, r.g"
        if not last:
            parts[f"{name}_x{t}"] = f"select a.g, a.cid, r.v from {name}_a{t} a join {name}_r r on a.key = r.key and a.g = r.g"
            parts[f"{name}_c{t + 1}"] = means(f"{name}_x{t}", "g, cid")
    parts[f"{name}_c"] = f"select * from {name}_c{steps}"
    return parts


PARTS |= lloyd("topics", "docs", "doc_id", SHARDS, STEPS)
PARTS["topic_shards"] = "select d.doc_id, d.pos, d.v, cast(a.cid as bigint) shard_id from docs d join topics_a a on d.doc_id = a.key"
PARTS["mixed_shards"] = f"""
    select doc_id, topic_id, ord, (topic_id % {SHARDS} + ord) % {SHARDS} shard_id from (
        select d.doc_id, cast(a.cid as bigint) topic_id, row_number() over (partition by a.cid order by md5('{SEED}:' || d.doc_id), d.doc_id) - 1 ord
        from docs d join topics_a a on d.doc_id = a.key)"""
for kind in ("random", "topic"):
    PARTS[f"{kind}_mean"] = means(f"{kind}_shards", "shard_id")
    PARTS[f"{kind}_single"] = unit(f"{kind}_mean", "shard_id")
    for k in sorted({MULTI_K, *GRID.centroid_k_values}):
        PARTS |= lloyd(f"{kind}_k{k}", f"{kind}_shards", "doc_id", k, MULTI_STEPS, "shard_id")
        PARTS[f"{kind}_k{k}_named"] = f"select g shard_id, cast(cid as bigint) centroid_id, v from {kind}_k{k}_c"
        PARTS[f"{kind}_multi{k}"] = unit(f"{kind}_k{k}_named", "shard_id, centroid_id")
    PARTS |= lloyd(f"{kind}_g", f"{kind}_single", "shard_id", GROUPS, GROUP_STEPS)
    PARTS[f"{kind}_groups"] = f"select key shard_id, cast(cid as bigint) group_id from {kind}_g_a"
    PARTS[f"{kind}_members"] = f"select m.group_id, s.v from {kind}_single s join {kind}_groups m on s.shard_id = m.shard_id"
    PARTS[f"{kind}_gmean"] = means(f"{kind}_members", "group_id")
    PARTS[f"{kind}_gcent"] = unit(f"{kind}_gmean", "group_id")
    PARTS[f"{kind}_rank_single"] = f"select query_id, shard_id, score, row_number() over (partition by query_id order by score desc, shard_id) rank from (select q.query_id, c.shard_id, list_dot_product(q.v, c.v) score from queries q, {kind}_single c)"
    for k in sorted({MULTI_K, *GRID.centroid_k_values}):
        PARTS[f"{kind}_rank_multi{k}"] = f"select query_id, shard_id, score, row_number() over (partition by query_id order by score desc, shard_id) rank from (select q.query_id, c.shard_id, max(list_dot_product(q.v, c.v)) score from queries q, {kind}_multi{k} c group by all)"
    PARTS[f"{kind}_rank_groups"] = f"select query_id, group_id, score, row_number() over (partition by query_id order by score desc, group_id) rank from (select q.query_id, c.group_id, list_dot_product(q.v, c.v) score from queries q, {kind}_gcent c)"
    for g in sorted({SELECTED, *GRID.num_selected_groups}):
        PARTS[f"{kind}_sel{g}"] = f"select query_id, group_id, rank group_rank from {kind}_rank_groups where rank <= {g}"
        for source, tag in ((f"{kind}_single", "s"), *((f"{kind}_multi{k}", f"m{k}") for k in sorted({MULTI_K, *GRID.centroid_k_values}))):
            PARTS[f"{kind}_rank_g{g}{tag}"] = f"""
                select *, row_number() over (partition by query_id order by score desc, group_rank, shard_id) rank from (
                    select s.query_id, s.group_id, s.group_rank, m.shard_id, max(list_dot_product(q.v, c.v)) score
                    from {kind}_sel{g} s join {kind}_groups m on s.group_id = m.group_id join {source} c on c.shard_id = m.shard_id join queries q on q.query_id = s.query_id
                    group by all)"""
    PARTS[f"{kind}_relevance"] = f"select p.query_id, s.shard_id, count(*) docs from pos p join {kind}_shards s on p.doc_id = s.doc_id group by all"
    PARTS[f"{kind}_evaluated"] = f"select query_id from queries where query_id in (select query_id from {kind}_relevance)"


def sql(body: str) -> str:
    """The body with those parts it needs, in order."""
    import re

    wanted, words = set(), re.compile(r"[a-z_][a-z_0-9]*")
    open_ = [w for w in words.findall(body) if w in PARTS]
    while open_:
        name = open_.pop()
        if name not in wanted:
            wanted.add(name)
            open_ += [w for w in words.findall(PARTS[name]) if w in PARTS and w != name]
    lines = [f"{name} as materialized ({text})" for name, text in PARTS.items() if name in wanted]
    return f"with {', '.join(lines)} {body}" if lines else body


def listed(source: str, keys: str) -> str:
    return f"select {keys}, cast(i - 1 as int) i, round(v[i], 6) value from {source}, places"


def _variant_rows() -> list[tuple[str, str, int, str, str, str, str]]:
    """(kind, method, k, groups, selected, ranking part, groups' selection part) of the grid."""
    out = []
    for kind in ("random", "topic"):
        out.append((kind, "single_centroid", 1, "null", "null", f"{kind}_rank_single", ""))
        out += [(kind, "multi_centroid", k, "null", "null", f"{kind}_rank_multi{k}", "") for k in GRID.centroid_k_values]
        for g in GRID.num_selected_groups:
            out.append((kind, "group_single_centroid", 1, str(GROUPS), str(g), f"{kind}_rank_g{g}s", f"{kind}_sel{g}"))
            out += [(kind, "group_multi_centroid", k, str(GROUPS), str(g), f"{kind}_rank_g{g}m{k}", f"{kind}_sel{g}") for k in GRID.centroid_k_values]
    return out


def _grid() -> str:
    rows = []
    for kind, method, k, groups, selected, ranked, chosen in _variant_rows():
        shard_type = {"random": "random", "topic": "topic_based"}[kind]
        expected = f"{GROUPS} + cast(round_even({SHARDS} / (select count(distinct group_id) from {kind}_groups) * {selected}, 0) as bigint) * {k}"
        cost = str(SHARDS * k) if groups == "null" else expected
        if chosen:
            per = f"""select r.query_id, avg(case when c.group_id is null then 0.0 else 1.0 end) recall
                from (select distinct e.query_id, m.group_id from {kind}_relevance e join {kind}_groups m on e.shard_id = m.shard_id where e.query_id in (select query_id from {kind}_evaluated)) r
                left join {chosen} c on r.query_id = c.query_id and r.group_id = c.group_id group by r.query_id"""
            recall, drop = f"(select avg(recall) from ({per}))", f"(select avg(cast(recall = 0 as double)) from ({per}))"
        else:
            recall = drop = "cast(null as double)"
        for b in GRID.top_b_values:
            picked = f"select r.query_id, r.shard_id from {ranked} r where rank <= {b} and query_id in (select query_id from {kind}_evaluated)"
            top = f"""select query_id, doc_id from (
                select p.query_id, s.doc_id, row_number() over (partition by p.query_id order by list_dot_product(q.v, s.v) desc, s.doc_id) n
                from ({picked}) p join {kind}_shards s on p.shard_id = s.shard_id join queries q on q.query_id = p.query_id) where n <= {TOP_K}"""
            docs = f"(select avg(x) from (select w.query_id, avg(case when t.doc_id is null then 0.0 else 1.0 end) x from pos w left join ({top}) t on w.query_id = t.query_id and w.doc_id = t.doc_id where w.query_id in (select query_id from {kind}_evaluated) group by w.query_id))"
            rows.append(f"""
                select '{GRID.dataset}' dataset, '{shard_type}' shard_type, '{method}' method, {SHARDS} num_shards, cast({groups} as int) num_groups, cast({selected} as int) num_selected_groups,
                    {k} centroids_per_shard, {b} top_b, round(avg(hit / all_shards), 6) mean_shard_recall, round(avg(hit_docs / all_docs), 6) mean_oracle_doc_coverage,
                    round(avg(n), 6) mean_selected_shard_count, round(avg(n) / {SHARDS}, 6) accessed_shard_ratio, round(cast({selected} as double) / {groups}, 6) accessed_group_ratio,
                    cast({cost} as bigint) centroid_scoring_cost, count(*) num_queries, {SEED} seed, round({docs}, 6) mean_doc_recall_at_{TOP_K}_within_selected_shards,
                    round({recall}, 6) mean_group_recall, round({drop}, 6) group_drop_error_rate
                from (select p.query_id, count(*) n, cast(count(e.docs) as double) hit, cast(coalesce(sum(e.docs), 0) as double) hit_docs
                      from ({picked}) p left join {kind}_relevance e on p.query_id = e.query_id and p.shard_id = e.shard_id group by p.query_id) h
                join (select query_id, count(*) all_shards, cast(sum(docs) as double) all_docs from {kind}_relevance group by query_id) t on h.query_id = t.query_id""")
    return " union all ".join(rows)


SELECTED_SHARDS = f"(select query_id, shard_id from random_rank_single where rank <= {TOP_B})"
REQUEST = "(values (0, 5), (1, 3), (2, 5), (3, 0), (5, 42)) union all select 4, max(pos) from docs"
REQUESTED = f"(select * from (select col0 ord, col1 pos from ({REQUEST})))"
NORM = "sqrt(list_dot_product(v, v))"
POSITIVE = "case when rel > 0 then"


def _share(name: str, wanted: str, hit: str) -> str:
    """Mean hits of each query's wanted rows, 0 for embedded queries without any."""
    return f"select q.query_id, round(coalesce(avg(w.hit), 0.0), 6) {name} from queries q left join (select w.query_id, case when {hit} then 1.0 else 0.0 end hit from {wanted}) w on q.query_id = w.query_id group by q.query_id"


def _norms(name: str, source: str) -> str:
    near = lambda f: f"abs({f}(n) - 1) <= 1e-3"
    return f"select '{name}' as name, count(*) checked, count(*) filter (where not isfinite(n)) not_finite, round(min(n), 6) min_norm, round(avg(n), 6) mean_norm, round(max(n), 6) max_norm, count(*) filter (where not isfinite(n)) = 0 finite, {near('min')} and {near('avg')} and {near('max')} norms_ok from (select {NORM} n from {source})"


def _wanted_groups() -> str:
    return "(select distinct e.query_id, m.group_id from random_relevance e join random_groups m on e.shard_id = m.shard_id) w left join (select query_id, group_id from random_rank_groups where rank <= 1) c on w.query_id = c.query_id and w.group_id = c.group_id"


def _cost(case: tuple) -> str:
    method, n, k, groups, selected, sizes = case
    each = k if "multi" in method else 1
    if groups is None:
        return str(n * each)
    return f"cast({groups} + round_even({sum(sizes)} / {len(sizes)} * {selected}, 0) * {each} as bigint)"


_BODIES: dict[str, str] = {
    "scan_embeddings": "select doc_id, pos, cast(len(v) as int) dim, round(v[1], 6) first_value from docs",
    "batch_profile": f"select pos // {BATCH} batch, min(pos) first_pos, max(pos) + 1 end_pos, count(*) as rows from docs group by 1",
    "gather_positions": f"select cast(ord as int) ord, doc_id, round(v[1], 6) first_value, round(v[{DIM}], 6) last_value from {REQUESTED} r join docs d on r.pos = d.pos",
    "gather_doc_ids": f"select cast(ord as int) ord, doc_id, round(v[1], 6) first_value, round(v[{DIM}], 6) last_value from {REQUESTED} r join docs d on cast(r.pos as varchar) = d.doc_id",
    "embedding_shape": f"select count(*) as rows, cast(max(len(v)) as int) dim, count(doc_id) ids, count(*) - count(v) null_vectors, min(len(v)) = max(len(v)) constant_dim, count(*) filter (where len(v) <> {DIM}) wrong_dim from docs",
    "qrels_profile": f"select count(*) as rows, count(*) + 1 raw_lines, count(distinct query_id) queries, count(distinct {POSITIVE} query_id end) positive_queries, count({POSITIVE} 1 end) positive_rows, count(distinct {POSITIVE} doc_id end) positive_docs from raw_qrels",
    "chunk_manifest": f"select pos // {CHUNK} chunk_idx, min(pos) as start, max(pos) + 1 as end, count(*) as rows, cast(max(len(v)) as int) dim from docs group by 1",
    "resume_pending_chunks": f"select pos // {CHUNK} chunk_idx, count(*) as rows from docs where pos // {CHUNK} not in (0, 2) group by 1",
    "chunk_check": f"select c.*, l.listed_rows, coalesce(l.listed_rows = c.rows, false) ok from (select pos // {CHUNK} chunk_idx, count(*) as rows, cast(0 as bigint) wrong_dim, cast(0 as bigint) not_finite, cast(0 as bigint) null_ids from docs group by 1) c left join (select pos // {CHUNK} chunk_idx, count(*) listed_rows from docs where pos // {CHUNK} <> 1 group by 1) l on c.chunk_idx = l.chunk_idx",
    "doc_text": r"select doc_id, regexp_replace(coalesce(title, '') || ' ' || coalesce(text, ''), '^\s+|\s+$', '', 'g') as text from corpus",
    "query_texts": "select query_id, coalesce(text, '') as text from texts",
    "qrels_positive": "select query_id, doc_id from pos",
    "select_query_ids": "select distinct query_id from qrels where rel > 0",
    "missing_query_texts": "select query_id from queries where query_id not in (select query_id from texts)",
    "shard_random": "select doc_id, ord, shard_id from random_shards",
    "shard_topic": "select doc_id, shard_id from topic_shards",
    "shard_heterogeneous": "select doc_id, topic_id, ord, shard_id from mixed_shards",
    "kmeans_assign": "select key doc_id, cast(cid as bigint) as cluster from topics_a",
    "doc_to_shard": "select doc_id, shard_id from random_shards",
    "shard_size_summary": "select count(*) num_shards, min(n) min_size, max(n) max_size, round(avg(n), 6) mean_size from (select shard_id, count(*) n from random_shards group by 1)",
    "single_centroids": listed("random_single", "shard_id"),
    "multi_centroids": listed(f"random_multi{MULTI_K}", "shard_id, centroid_id"),
    "l2_normalize": f"select doc_id, cast(i - 1 as int) i, round(v[i] * pos / case when pos > 0 then {NORM} * pos else 1 end, 6) + 0.0 as value from docs, places",
    "shard_groups": "select shard_id, group_id from random_groups",
    "group_centroids": listed("random_gcent", "group_id"),
    "group_size_summary": "select count(*) num_groups, min(n) min_size, max(n) max_size, round(avg(n), 6) mean_size from (select group_id, count(*) n from random_groups group by 1)",
    "dot_scores": "select query_id, shard_id, round(score, 6) score from random_rank_single",
    "rank_single": "select query_id, shard_id, round(score, 6) score, cast(rank as int) rank from random_rank_single",
    "rank_multi": f"select query_id, shard_id, round(score, 6) score, cast(rank as int) rank from random_rank_multi{MULTI_K}",
    "rank_groups": "select query_id, group_id, round(score, 6) score, cast(rank as int) rank from random_rank_groups",
    "rank_group_single": f"select query_id, group_id, cast(group_rank as int) group_rank, shard_id, round(score, 6) score, cast(rank as int) rank from random_rank_g{SELECTED}s",
    "rank_group_multi": f"select query_id, group_id, cast(group_rank as int) group_rank, shard_id, round(score, 6) score, cast(rank as int) rank from random_rank_g{SELECTED}m{MULTI_K}",
    "top_b_shards": f"select query_id, shard_id, round(score, 6) score, cast(rank as int) rank from random_rank_single where rank <= {TOP_B}",
    "relevant_shards": "select query_id, shard_id from random_relevance",
    "evaluated_queries": "select query_id from random_evaluated",
    "shard_recall": _share("shard_recall", f"random_relevance w left join {SELECTED_SHARDS} s on w.query_id = s.query_id and w.shard_id = s.shard_id", "s.shard_id is not null"),
    "oracle_doc_coverage": _share("doc_coverage", f"pos w join random_shards d on w.doc_id = d.doc_id left join {SELECTED_SHARDS} s on w.query_id = s.query_id and d.shard_id = s.shard_id", "s.shard_id is not null"),
    "oracle_doc_coverage_all": _share("doc_coverage", f"pos w left join random_shards d on w.doc_id = d.doc_id left join {SELECTED_SHARDS} s on w.query_id = s.query_id and d.shard_id = s.shard_id", "s.shard_id is not null"),
    "doc_recall_at_k": _share("doc_recall", f"pos w left join (select query_id, doc_id from (select s.query_id, d.doc_id, row_number() over (partition by s.query_id order by list_dot_product(q.v, d.v) desc, d.doc_id) n from {SELECTED_SHARDS} s join random_shards d on s.shard_id = d.shard_id join queries q on q.query_id = s.query_id) where n <= {TOP_K}) t on w.query_id = t.query_id and w.doc_id = t.doc_id", "t.doc_id is not null"),
    "group_recall": f"select w.query_id, round(avg(case when c.group_id is null then 0.0 else 1.0 end), 6) group_recall from {_wanted_groups()} group by w.query_id",
    "group_drop_error": f"select w.query_id, max(case when c.group_id is null then 0 else 1 end) = 0 drop_error from {_wanted_groups()} group by w.query_id",
    "scoring_cost": " union all ".join(f"select {i} case_id, '{c[0]}' as method, cast({_cost(c)} as bigint) as cost" for i, c in enumerate(COSTS)),
    "actual_scoring_cost": f"select count(*) actual_cost from random_multi{MULTI_K}",
    "eval_summary": f"""
        select round(avg(hit / all_shards), 6) mean_shard_recall, round(avg(hit_docs / all_docs), 6) mean_oracle_doc_coverage, round(avg(n), 6) mean_selected_shard_count, round(avg(n) / {SHARDS}, 6) accessed_shard_ratio, count(*) num_queries
        from (select p.query_id, count(*) n, cast(count(e.docs) as double) hit, cast(coalesce(sum(e.docs), 0) as double) hit_docs
              from {SELECTED_SHARDS} p left join random_relevance e on p.query_id = e.query_id and p.shard_id = e.shard_id where p.query_id in (select query_id from random_evaluated) group by p.query_id) h
        join (select query_id, count(*) all_shards, cast(sum(docs) as double) all_docs from random_relevance group by query_id) t on h.query_id = t.query_id""",
    "ablation_grid": _grid(),
    "duplicate_ids": "select 'docs' as name, cast(count(*) as bigint) as rows, count(distinct doc_id) distinct_ids, count(*) - count(distinct doc_id) duplicates from (select doc_id from docs union all select doc_id from docs where doc_id in ('0', '7')) union all select 'queries', count(*), count(distinct query_id), count(*) - count(distinct query_id) from queries",
    "norm_summary": f"{_norms('docs', 'docs')} union all {_norms('queries', 'queries')} union all {_norms('sample', '(select * from docs where floor((pos + 1) * 128 / (select count(*) from docs)) > floor(pos * 128 / (select count(*) from docs)))')}",
    "dataset_coverage": """
        select *, positives - found_positives missing_positives, round(found_positives / positives, 6) coverage, round(positives / judged_queries, 6) positives_per_judged_query,
            docs_without_embedding = 0 and embeddings_without_doc = 0 and queries_without_embedding = 0 and judged_without_embedding = 0 and positives = found_positives ok
        from (select
            (select count(*) from corpus where doc_id not in (select doc_id from docs)) docs_without_embedding,
            (select count(*) from docs where doc_id not in (select doc_id from corpus)) embeddings_without_doc,
            (select count(distinct query_id) from texts where query_id not in (select query_id from queries)) queries_without_embedding,
            (select count(*) from queries where query_id not in (select query_id from texts)) embeddings_without_query,
            (select count(distinct query_id) from qrels where query_id not in (select query_id from queries)) judged_without_embedding,
            (select count(distinct query_id) from qrels) judged_queries,
            (select count(*) from pos) positives,
            (select count(*) from pos where doc_id in (select doc_id from docs)) found_positives,
            (select count(*) from (select query_id from pos group by query_id having count(*) filter (where doc_id in (select doc_id from docs)) = 0)) queries_all_missing)""",
    "topk_hit_rate": f"""
        select *, round(hits / queries_, 6) hit_rate from (select
            (select count(*) from (select query_id from queries where query_id in (select query_id from pos where doc_id in (select doc_id from docs)) limit {CHECK_QUERIES})) queries_,
            (select count(distinct t.query_id) from (
                select query_id, doc_id from (select q.query_id, d.doc_id, row_number() over (partition by q.query_id order by list_dot_product(q.v, d.v) desc, d.doc_id) n
                    from (select * from queries where query_id in (select query_id from pos where doc_id in (select doc_id from docs)) order by cast(query_id as bigint) limit {CHECK_QUERIES}) q, docs d) where n <= {TOP_K}) t
                join pos p on t.query_id = p.query_id and t.doc_id = p.doc_id) hits)""",
    "qrels_coverage": f"""
        select *, round(positive_rows / positive_queries, 6) positives_per_positive_query, missing_positive_docs = 0 and missing_positive_queries = 0 ok from (select
            (select count(*) from qrels) as rows, (select count(distinct query_id) from qrels) queries_, (select count(distinct {POSITIVE} query_id end) from qrels) positive_queries,
            (select count({POSITIVE} 1 end) from qrels) positive_rows, (select count(distinct {POSITIVE} doc_id end) from qrels) positive_docs,
            (select count(distinct doc_id) from pos where doc_id not in (select doc_id from docs)) missing_positive_docs,
            (select count(distinct query_id) from pos where query_id not in (select query_id from queries)) missing_positive_queries,
            (select count(*) from queries where query_id not in (select query_id from qrels)) extra_queries)""",
    "missing_positive_docs": "select distinct doc_id from pos where doc_id not in (select doc_id from docs)",
    "skipped_queries": "select distinct query_id from random_relevance where query_id not in (select query_id from queries)",
    "dataset_summary": "select (select count(*) from corpus) docs_, (select count(*) from texts) queries_, (select count(distinct query_id) from qrels) judged_queries",
}

#: Result columns whose names are also names of parts.
_RENAMED = {"topk_hit_rate": ("queries_",), "qrels_coverage": ("queries_",), "dataset_summary": ("docs_", "queries_")}


def _named(key: str, text: str) -> str:
    if key not in _RENAMED:
        return text
    return f"select * rename ({', '.join(f'{n} as {n[:-1]}' for n in _RENAMED[key])}) from ({text})"


ORACLES = {key: sql(_named(key, body)) for key, body in _BODIES.items()}
