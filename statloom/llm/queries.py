"""One query for each operator, over its whole table with production parameters, and the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.sources.tables import Tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def register(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return register


NEAR_SQL = r"""
with recursive words as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
shingles as (
  select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
         else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end) as s from words),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as k from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)),
reach as (
  select doc_id as node, doc_id as low from documents
  union select l.b, r.low from reach r join links l on l.a = r.node)
select d.doc_id, coalesce(s.n, 0) as n_shingles, c.low as component_id, d.doc_id = c.low as kept
from documents d left join sizes s using (doc_id) join (select node, min(low) as low from reach group by node) c on c.node = d.doc_id
"""


@query("op1_near_duplicates", NEAR_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    from statloom.llm.minhash import near_duplicates
    return near_duplicates(Tables(spark, folder).documents)


MIX_SQL = r"""
with recursive work as (
  select {row}, coalesce('=' || source, '') as lane, md5(coalesce(cast(doc_id as varchar), '')) as mark,
         coalesce(length(text), 0) as size from {docs}),
totals as (select lane, sum(size)::bigint as chars, floor(sqrt(sum(size)::bigint))::bigint as weight from work group by lane),
shares as (select lane, greatest(floor(1000 * weight / greatest((select sum(weight) from totals), 1)), 1)::bigint as parts from totals),
cfg as (select list(lane order by lane) as lanes, list(parts order by lane) as a, sum(parts)::bigint as q from shares),
edf as (
  select -1::bigint as t, list_transform(a, lambda x: 0::bigint) as k, 0::bigint as pick, 0::bigint as turn from cfg
  union all
  select t + 1, list_transform(range(len(k)), lambda i: k[i + 1] + (case when i = p then 1 else 0 end)::bigint), p, k[p + 1]
  from (select t, k, list_min(list_transform(range(len(k)), lambda i: case when k[i + 1] < a[i + 1] and (k[i + 1] * q) // a[i + 1] <= t + 1
                then (((k[i + 1] + 1) * q + a[i + 1] - 1) // a[i + 1]) * 1000000 + i end)) % 1000000 as p
        from edf, cfg where t + 1 < q)),
slots as (select lanes[pick + 1] as lane, a[pick + 1] as parts, turn, t as slot, q from edf, cfg where t >= 0),
placed as (select *, (coalesce(sum(size) over (partition by lane order by mark, size rows between unbounded preceding and 1 preceding), 0))::bigint as place from work)
select {out}, place // 100000 as mix_block, ((place // 100000) // parts) * q + slot as mix_slot, place as mix_place
from placed p join slots s on p.lane = s.lane and s.turn = (place // 100000) % parts
"""


@query("op3_mix_sources", MIX_SQL.format(row="doc_id, source", docs="documents", out="doc_id, source"))
def op3(spark: SparkSession, folder: str) -> DataFrame:
    from statloom.llm.mixing import mix_sources
    docs = Tables(spark, folder).documents.select("doc_id", "source", F.length("text").alias("size"))
    return mix_sources(docs, size=F.col("size")).drop("size")


@query("op7_language")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    from statloom.llm import langid
    docs = Tables(spark, folder).documents
    held = langid.held_out("doc_id", 4, 2)
    model = langid.fit_language_model(docs.filter(~held))
    out = langid.identify_language(docs.select("doc_id", "text", held.alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")


@query("op8_contaminated")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    from statloom.llm.decontaminate import contaminated
    tables = Tables(spark, folder)
    return contaminated(tables.documents, tables.benchmark)


WINDOW_SQL = r"""
with words as (
  select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
runs as (select doc_id, unnest(range(1, len(w) - 18)) as s, w from words),
late as (select doc_id, s from (select doc_id, s, row_number() over (
  partition by array_to_string(w[s:s + 19], ' ') order by doc_id, s) as k from runs) where k > 1),
gone as (select distinct doc_id, unnest(range(s, s + 20)) as p from late),
flat as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from words),
kept as (select doc_id, string_agg(word, ' ' order by p) as t, count(*) as n from flat anti join gone using (doc_id, p) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from words d left join kept using (doc_id)
"""


@query("op9_repeated_windows", WINDOW_SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    from statloom.llm.windows import drop_repeated_windows
    return drop_repeated_windows(Tables(spark, folder).documents).drop("kept_text")


@query("op2_repeated_strings")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    from statloom.llm.substrings import drop_repeated_strings
    return drop_repeated_strings(Tables(spark, folder).documents).drop("kept")


CHAT_SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
marked as (
  select *, regexp_replace(replace(text, '\', '\\'), '(<\||</?s>|\[/?INST\]|<</?SYS>>)', '\1\\', 'g') as body,
         regexp_replace(replace(role, '\', '\\'), '(<\||</?s>|\[/?INST\]|<</?SYS>>)', '\1\\', 'g') as head from turns)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(head) + length(body) + 23)::bigint as formatted_chars
from marked group by conv_id
"""


@query("op4_chat", CHAT_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    from statloom.llm.chat import digests, format_conversations
    table = Tables(spark, folder).conversations.select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digests(*format_conversations(table.unionByName(extra)))


@query("op10_nearest_neighbours")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    from statloom.llm.neighbours import nearest_neighbours
    return nearest_neighbours(Tables(spark, folder).embeddings, F.col("vec_id") % 100 == 0)


@query("op5_toxicity")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    from statloom.llm.langid import held_out
    from statloom.llm.toxicity import fit_toxicity, score_toxicity
    tables = Tables(spark, folder)
    held = held_out("doc_id", 5, 0)
    model = fit_toxicity(tables.documents, tables.labels.filter(~held))
    out = score_toxicity(tables.documents.select("doc_id", "text", held.alias("held_out")), model)
    return out.select("doc_id", "held_out", "score", "predicted")


@query("op6_main_text")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    from statloom.llm.extract import extract_main_text, fit_labeller
    pages = Tables(spark, folder).pages.select("page_id", "url", "html")
    return extract_main_text(pages, fit_labeller(pages))


RUN_SQL = r"""
with split as (
  select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w,
    xor(list_reduce([4294967295::bigint] || list_transform(string_split(cast(doc_id as varchar), ''), lambda c: ascii(c)::bigint), lambda c, x:
      list_reduce([xor(c, x)] || [0::bigint, 0, 0, 0, 0, 0, 0, 0], lambda y, z: case when y & 1 = 1 then xor(y >> 1, 3988292384) else y >> 1 end)),
      4294967295::bigint) as h from documents),
told as (select doc_id, w, len(w) as n, h % 10 = 0 and len(w) > 0 as planted, (h // 10) % greatest(len(w), 1) as a, (h // 10) % 8 as e from split),
words as (
  select doc_id, n, case when planted then list_transform(range(n), lambda i: case when i < a then w[i + 1] else w[a + (i - a) % (1 + (n - a) // (3 + e)) + 1] end)
    else w end as w from told),
flat as (select doc_id, n, unnest(w) as word, unnest(range(n)) as i from words),
pairs as (select a.doc_id, b.i - a.i as q, a.i from flat a join flat b on a.doc_id = b.doc_id and a.word = b.word and b.i > a.i and 4 * (b.i - a.i) <= a.n),
stretches as (
  select doc_id, q, min(i) as s, count(*) + q as l from (select *, i - row_number() over (partition by doc_id, q order by i) as g from pairs)
  group by doc_id, q, g having count(*) + q >= greatest(6, 4 * q)),
runs as (select doc_id, s, l, min(q) as q from stretches group by doc_id, s, l),
gone as (select distinct doc_id, unnest(range(s + q, s + l)) as i from runs),
kept as (select doc_id, string_agg(word, ' ' order by i) as t from flat anti join gone using (doc_id, i) group by doc_id),
found as (
  select doc_id, count(*) as k, string_agg(s || ',' || l || ',' || q || chr(10), '' order by s, q) as t,
    first({'s': s, 'l': l, 'q': q} order by l desc, s, q) as best from runs group by doc_id)
select doc_id, coalesce(k, 0)::bigint as n_runs, best.s::bigint as start, best.l::bigint as length, best.q::bigint as period,
  (1000 * best.l // best.q)::bigint as exponent_milli, sha256(coalesce(found.t, '')) as runs_sha256, sha256(coalesce(kept.t, '')) as collapsed_sha256
from words left join found using (doc_id) left join kept using (doc_id)
"""


@query("op11_periodic_runs", RUN_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    from statloom.llm.periodic import periodic_runs, run_digests, with_planted_tails
    return run_digests(periodic_runs(with_planted_tails(Tables(spark, folder).documents.select("doc_id", "text"))))


@query("op12_packing")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers
    from statloom.llm.packing import pack_documents
    pieces = pack_documents(Tables(spark, folder).documents, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


NEGATIVE_SQL = """
with rows as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where label is not null and embedding is not null and coalesce(list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))), true)),
pairs as (
  select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as score
  from rows a join rows b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
positives as (select * from pairs where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select p.anchor_id, p.id as positive_id, (row_number() over (partition by p.anchor_id, p.id order by n.score desc, n.id))::int as rank,
  n.id as negative_id, p.score as positive_score, n.score as negative_score
from positives p join pairs n on n.anchor_id = p.anchor_id and not n.same and 30 * p.score <= 100 * n.score and 100 * n.score <= 90 * p.score
qualify rank <= 10
"""


@query("op13_hard_negatives", NEGATIVE_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    from statloom.llm.negatives import hard_negatives
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(Tables(spark, folder).embeddings, F.col("vec_id") % 100 == 0, label)
