"""The ``opN_`` queries of the corpus operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.bpe import encode_digest
from brindle.llm.common import fold, table
from brindle.llm.conversations import repair_conversations
from brindle.llm.embedding_dedup import embedding_components
from brindle.llm.exact_dedup import exact_dedup
from brindle.llm.html_extract import extract_text
from brindle.llm.jaccard_join import jaccard_components
from brindle.llm.language_id import FOLDS, HELD_OUT, predict_languages
from brindle.llm.language_model import score_documents
from brindle.llm.packing import pack_documents
from brindle.llm.phrases import collocations
from brindle.llm.pii import pii_digest, pii_spans
from brindle.llm.power_packing import power_sequences
from brindle.llm.quality import GOOD, fit_quality, score_quality

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT_DEDUP_SQL = f"""
with t as (select doc_id, {_LOWER} as x from documents)
select doc_id, max(doc_id) over (partition by x) as keep_id, count(*) over (partition by x) as group_size,
       doc_id = max(doc_id) over (partition by x) as kept, sha256(x) as text_sha256
from t
"""


EMBEDDINGS_SQL = """
with recursive v as (select vec_id, cast(embedding as double[]) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.95),
r as (select vec_id as id, vec_id as root from embeddings union select l.a, r.root from r join l on l.b = r.id),
c as (select id, min(root) as component_id from r group by id),
n as (select a as id, count(*) as n from l group by a)
select c.id as vec_id, coalesce(n.n, 0) as n_links, c.component_id, c.id = c.component_id as kept from c left join n using (id)
"""


JACCARD_SQL = f"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
  when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from w),
g as (select doc_id, len(s) as n, unnest(s) as g from s),
p as (select a.doc_id as a, b.doc_id as b from g a join g b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id, a.n, b.n
  having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
l as (select a, b from p union all select b, a from p),
r as (select doc_id as id, doc_id as root from documents union select l.a, r.root from r join l on l.b = r.id)
select s.doc_id, len(s.s) as n_shingles, min(r.root) as component_id from s join r on r.id = s.doc_id group by s.doc_id, len(s.s)
"""


PHRASES_SQL = f"""
with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) as p from documents),
w as (select lang, regexp_extract_all(p, '[^\\x20\\x09]+') as w from p),
g as (select lang, d, unnest(list_transform(range(1, len(w) - d + 2), lambda i: array_to_string(w[i:i + d - 1], ' '))) as phrase from w, (values (1), (2), (3), (4)) as t(d)),
f as (select lang, d, phrase, count(*) as f from g group by all),
n as (select lang, sum(f)::bigint as n from f where d = 1 group by lang),
c as (select lang, d, phrase, f as a, string_split(phrase, ' ') as w from f where d > 1 and f >= 30),
k as (select c.*, k, array_to_string(w[1:k], ' ') as one, array_to_string(w[k + 1:], ' ') as two from c, (values (1), (2), (3)) as t(k) where k < d),
s as (select k.*, x.f as l, y.f as r, (2000000::hugeint * a) // (x.f + y.f) as score from k join f x on x.lang = k.lang and x.phrase = k.one join f y on y.lang = k.lang and y.phrase = k.two),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
i as (select lang, a, unnest(list_filter(flatten(list_transform(range(2, d), lambda m: list_transform(range(1, d - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' ')))), lambda x: x <> '')) as phrase from c where d > 2),
m as (select lang, phrase, max(a) as most from i group by all),
o as (select b.* from b left join m on b.lang = m.lang and b.phrase = m.phrase where most is null or 100::hugeint * most < 80::hugeint * b.a),
r as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from o)
select lang, rank, phrase, a, l, r.r, n, score::bigint as score from r join n using (lang) where rank <= 2000
"""


def _turn(state: int) -> str:
    """SQL: the cheapest of deleting, keeping and rerolling a turn, by what stands ahead of it: nothing, system, user, assistant."""
    role, own = (2, 2, 3, 2)[state], "case when fault = 3 then 5 else 0 end"
    keep = f"case when fault in (1, 2) then null when code = {role} then {{'c': {own} + g{role}.c, 'a': 'K' || g{role}.a}}" + (f" when code = 1 then {{'c': {own} + g1.c, 'a': 'K' || g1.a}}" if state == 0 else "") + " end"
    turn = f"case when fault in (1, 2) then null else {{'c': 1 + {own} + g{role}.c, 'a': 'R' || g{role}.a}} end"
    return f"list_min([{{'c': 2 + g{state}.c, 'a': 'D' || g{state}.a}}, {keep}, {turn}]) as h{state}"


def _insert(times: str, state: int) -> str:
    return f"{{'c': {5 * len(times)} + h{state}.c, 'a': '{times}' || h{state}.a}}"


_SAME = "conv_id is not distinct from"
_NEXT = "case state when 2 then 3 else 2 end"
_NAME = "case state when 2 then 'assistant' else 'user' end"
CONVERSATIONS_SQL = f"""
with recursive k as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
  coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
h as (select *, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(key) + 1), lambda i: ascii(key[i])::bigint)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: case when x % 2 = 1 then xor(x // 2, 3988292384::bigint) else x // 2 end)), 4294967295::bigint) % 20 as kind from k),
d as (select conv_id, turn, case when kind = 4 then 'user' else role end as role, case when kind = 1 then '' when kind = 2 then translate(text, '.!?', '') else text end as text,
  unnest(case when kind = 3 then [1, 2] else [1] end) as copy from h where kind <> 0),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i,
  rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as tail from d),
t as (select conv_id, turn, role, text, i, left(role, 1) as initial, case left(role, 1) when 's' then 1 when 'u' then 2 when 'a' then 3 else 0 end as code,
  case when tail = '' then 1 when row_number() over (partition by conv_id, role, text order by i) > 1 then 2 when right(tail, 1) not in ('.', '!', '?') then 3 else 0 end as fault from o),
c as (select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 1) as blank,
  count(*) filter (where fault = 2) as duplicate, count(*) filter (where fault = 3) as truncated from t group by conv_id),
l as (select conv_id, count(*) filter (where pair not in ('su', 'ua', 'au')) as illegal
  from (select conv_id, lag(initial) over (partition by conv_id order by i) || initial as pair from t) group by conv_id),
g as (select conv_id, n as i, {{'c': 0::bigint, 'a': ''}} as g0, {{'c': 10::bigint, 'a': 'II'}} as g1, {{'c': 5::bigint, 'a': 'I'}} as g2, {{'c': 0::bigint, 'a': ''}} as g3 from c
  union all
  select conv_id, i - 1, list_min([h0, {_insert('I', 2)}, {_insert('II', 3)}]), list_min([h1, {_insert('I', 2)}, {_insert('II', 3)}]), list_min([h2, {_insert('I', 3)}]), list_min([h3, {_insert('I', 2)}])
  from (select g.conv_id, g.i, {', '.join(map(_turn, range(4)))} from g join t on t.{_SAME} g.conv_id and t.i = g.i)),
e as (select conv_id, g0.c as cost, g0.a as audit from g where i = 0),
w as (select conv_id, audit, 1 as p, 1::bigint as i, 0 as state, []::varchar[] as said from e
  union all
  select w.conv_id, audit, p + 1, case when audit[p] = 'I' then w.i else w.i + 1 end, case audit[p] when 'D' then state when 'K' then code else {_NEXT} end,
    case audit[p] when 'D' then said when 'I' then list_append(said, {_NAME} || ':') when 'K' then list_append(said, role || ':' || text) else list_append(said, {_NAME} || ':' || text) end
  from w left join t on t.{_SAME} w.conv_id and t.i = w.i where p <= length(audit)),
r as (select conv_id, sha256(array_to_string(said, chr(10))) as repaired_sha256 from w where p = length(audit) + 1)
select a.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(cost, 0) as cost, coalesce(audit, '') as audit, coalesce(repaired_sha256, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) a left join c on c.{_SAME} a.conv_id left join l on l.{_SAME} a.conv_id left join e on e.{_SAME} a.conv_id left join r on r.{_SAME} a.conv_id
"""


def vocabulary() -> str:
    """The vocabulary file of the queries; every executor has it where the tokenizer files are installed."""
    return public_tokenizers.path("word_bpe_49k.json")


def byte_vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(table(spark, sf_dir, "embeddings"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digest(table(spark, sf_dir, "documents"), vocabulary())


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(pii_spans(table(spark, sf_dir, "documents")))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = predict_languages(table(spark, sf_dir, "documents"))
    held_out = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(table(spark, sf_dir, "conversations"))


def op13_power_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return power_sequences(table(spark, sf_dir, "documents"), byte_vocabulary())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_packing": op2_packing,
        "op3_quality": op3_quality,
        "op4_html": op4_html,
        "op5_embeddings": op5_embeddings,
        "op6_bpe": op6_bpe,
        "op7_language_model": op7_language_model,
        "op8_jaccard_join": op8_jaccard_join,
        "op9_pii": op9_pii,
        "op10_language_id": op10_language_id,
        "op11_phrases": op11_phrases,
        "op12_conversations": op12_conversations,
        "op13_power_packing": op13_power_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": EXACT_DEDUP_SQL, "op11_phrases": PHRASES_SQL, "op12_conversations": CONVERSATIONS_SQL, "op5_embeddings": EMBEDDINGS_SQL, "op8_jaccard_join": JACCARD_SQL}
