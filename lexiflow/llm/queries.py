"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.llm.bpe import bpe_codec
from lexiflow.llm.chosen_path import chosen_path_components
from lexiflow.llm.collocations import collocations
from lexiflow.llm.exact_dedup import exact_dedup
from lexiflow.llm.html_extract import html_text
from lexiflow.llm.licenses import license_scan
from lexiflow.llm.mixing import mix
from lexiflow.llm.ngram_join import ngram_components
from lexiflow.llm.periodic import looped, periodic_runs, run_columns
from lexiflow.llm.phrase_dedup import phrase_dedup
from lexiflow.llm.quality_rules import quality_rules
from lexiflow.llm.secrets import BASE, secret_spans
from lexiflow.llm.suffix_dedup import suffix_dedup
from lexiflow.session import spread


def vocabulary(name: str = "word_bpe_49k.json", folder: str | None = None) -> str:
    """Where a public tokenizer file lies: in ``folder``, the folder that LEXIFLOW_TOKENIZERS names, or the installed package."""
    folder = folder or os.environ.get("LEXIFLOW_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_documents(spark, sf_dir)).drop("rid", "spans")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(_documents(spark, sf_dir)).drop("rid", "root")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_dedup(_documents(spark, sf_dir)).drop("rid")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spread(_documents(spark, sf_dir))).select(
        "doc_id", "cell_source", "cell_lang", "cell_topic", "n_tokens", "target_weight", "probability", "wanted", "reached", "sampled"
    )


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(spread(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spread(_documents(spark, sf_dir)))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir)).drop("rid")


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec(spread(_documents(spark, sf_dir)), vocabulary()).select(
        "doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "boiler_words"
    )


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [r.kind for r in BASE]
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*names))
    return secret_spans(spread(_documents(spark, sf_dir))).select(
        "doc_id", *map(count, names), F.sha2(named(base), 256).alias("base_sha256"), named(F.col("spans")).alias("spans")
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_columns(periodic_runs(spread(_documents(spark, sf_dir)).withColumn("text", looped("doc_id", "text"))))


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path_components(_documents(spark, sf_dir)).drop("rid", "root")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spread(_documents(spark, sf_dir)))


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_array_dedup, op2_ngram_jaccard_join, op3_substring_dedup, op4_mixing, op5_html_extraction,
        op6_license_scan, op7_exact_dedup, op8_bpe_codec, op9_quality_rules, op10_secret_scan,
        op11_periodic_runs, op12_minhash_near_dedup, op13_phrase_collocations,
    )
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES = {
    "op2_ngram_jaccard_join": rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: md5(array_to_string(ws[i:i + 4], ' ')))
      when len(ws) > 0 then [md5(array_to_string(ws, ' '))] else [] end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
e as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 75 * (nx.n + ny.n - c)),
r as (select doc_id, doc_id as root from documents union select e.y, r.root from r join e on e.x = r.doc_id)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, min(r.root)::bigint as component_id
from documents d join r on r.doc_id = d.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id, n.n""",
    "op3_substring_dedup": rf"""
with w as (select doc_id, {_WORDS} as ws from documents),
g as (select doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) as h from (select doc_id, ws, unnest(range(1, len(ws) - 18)) as i from w)),
f as (select doc_id, i from (select doc_id, i, row_number() over (partition by h order by doc_id, i) as k from g) where k > 1),
c as (select distinct doc_id, unnest(range(i, i + 20)) as i from f),
u as (select doc_id, unnest(ws) as x, unnest(range(1, len(ws) + 1)) as i from w),
k as (select u.doc_id, count(c.i) as gone, coalesce(string_agg(case when c.i is null then u.x end, ' ' order by u.i), '') as t
      from u left join c on c.doc_id = u.doc_id and c.i = u.i group by u.doc_id)
select w.doc_id, len(ws)::bigint as n_words, coalesce(gone, 0)::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from w left join k on k.doc_id = w.doc_id""",
    "op7_exact_dedup": """
select doc_id, max(doc_id) over t as keep_id, count(*) over t as group_size, doc_id = max(doc_id) over t as kept, sha256(coalesce(text, '')) as text_sha256
from documents window t as (partition by coalesce(text, ''))""",
    "op9_quality_rules": rf"""
with w as (select doc_id, source, coalesce(text, '') as t, {_WORDS} as ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from documents),
g as (select doc_id, i, md5(array_to_string(ws[i:i + 7], ' ')) as h from (select doc_id, ws, unnest(range(1, len(ws) - 6)) as i from w)),
r as (select doc_id, count(distinct j) as n from (select doc_id, unnest(range(i, i + 8)) as j from (select *, count(*) over (partition by doc_id, h) as c from g) where c > 1) group by doc_id),
l as (select doc_id, source, md5(t) as body, lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))) as x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) as n from (select doc_id, source, t, unnest(ls) as x from w)),
h as (select source, greatest(10, count(distinct md5(t)) // 100) as most from w group by source),
f as (select l.source, x from l join h on l.source is not distinct from h.source group by l.source, x, most having count(distinct body) > most),
b as (select doc_id, sum(n) as n from l join f on l.x = f.x and l.source is not distinct from f.source group by doc_id),
m as (select w.doc_id, len(ws)::bigint as n_words, len(array_to_string(ws, ''))::bigint as word_chars, len(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
      (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words, coalesce(b.n, 0)::bigint as boiler_words
      from w left join r on r.doc_id = w.doc_id left join b on b.doc_id = w.doc_id),
j as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not (boiler_words > 0 and n_words - boiler_words < 0.3 * n_words) as kept, boiler_words from j""",
    "op11_periodic_runs": r"""
with recursive d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
c as (select doc_id, w, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ord(x)::bigint)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0,0,0,0,0,0,0,0]::bigint[]), lambda v, z: case when v & 1 = 1 then xor(v >> 1, 3988292384::bigint) else v >> 1 end)) as r from d),
h as (select doc_id, w, len(w) as n, xor(r, 4294967295::bigint) as h from c),
a as (select *, h // 10 as g from h),
p as (select *, case when n > 0 then g % n end as a, case when n > 0 then 1 + (n - g % n) // (3 + g % 8) end as p from a),
t as (select doc_id, case when h % 10 = 0 and n > 0 then list_transform(range(0, n), lambda i: w[1 + case when i < a then i else a + (i - a) % p end]) else w end as w from p),
u as (select doc_id, unnest(w) as x, unnest(range(0, len(w))) as i, len(w) as n from t),
m as (select a.doc_id, b.i - a.i as q, a.i from u a join u b on a.doc_id = b.doc_id and a.x = b.x and b.i > a.i and 4 * (b.i - a.i) <= a.n),
s as (select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as k from m),
v as (select doc_id, q, min(i) as s, count(*) + q as len from s group by doc_id, q, k having count(*) + q >= greatest(6, 4 * q)),
z as (select doc_id, s, len, min(q) as q from v group by all),
o as (select *, row_number() over (partition by doc_id order by len desc, s, q) as k from z),
f as (select doc_id, count(*) as n_runs, min(case when k = 1 then s end) as start, min(case when k = 1 then len end) as length, min(case when k = 1 then q end) as period,
      string_agg(s || ',' || len || ',' || q || chr(10), '' order by s, q) as lines from o group by doc_id),
g as (select distinct doc_id, unnest(range(s + q, s + len)) as i from z),
y as (select u.doc_id, string_agg(case when g.i is null then x end, ' ' order by u.i) as kept from u left join g on u.doc_id = g.doc_id and u.i = g.i group by u.doc_id)
select t.doc_id, coalesce(n_runs, 0)::bigint as n_runs, start::bigint as start, length::bigint as length, period::bigint as period, (1000 * length // period)::bigint as exponent_milli,
  sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(kept, '')) as collapsed_sha256, len(w)::bigint as n_words
from t left join f on f.doc_id = t.doc_id left join y on y.doc_id = t.doc_id""",
    "op12_minhash_near_dedup": r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) >= 2 then list_transform(range(1, len(ws)), lambda i: md5(ws[i] || ' ' || ws[i + 1]))
      when len(ws) > 0 then [md5(ws[1])] else [] end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
t as (select g, count(*) as often from s group by g),
o as (select s.doc_id, s.g, n, row_number() over (partition by s.doc_id order by often, s.g) as k from s join n on n.doc_id = s.doc_id join t on t.g = s.g),
p as (select distinct a.doc_id as x, b.doc_id as y from o a join o b on a.g = b.g and a.doc_id < b.doc_id
      where 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) and a.k <= a.n - (80 * a.n + 99) // 100 + 1 and b.k <= b.n - (80 * b.n + 99) // 100 + 1),
c as (select x, y, count(*) as c from p join s a on a.doc_id = x join s b on b.doc_id = y and b.g = a.g group by all),
l as (select x, y from c join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 80 * (nx.n + ny.n - c)),
e as (select x, y from l union all select y, x from l),
r as (select doc_id, doc_id as root from documents union select e.y, r.root from r join e on e.x = r.doc_id)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, min(r.root)::bigint as component_id, d.doc_id = min(r.root) as kept
from documents d join r on r.doc_id = d.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id, n.n""",
    "op13_phrase_collocations": r"""
with p as (select doc_id, coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as t from documents),
w as (select lang, regexp_extract_all(t, '[^\x20\x09]+') as ws from p),
c as (select lang, sum(len(ws))::hugeint as n from w group by lang),
g as (select lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1])) as g from w, unnest([1, 2, 3, 4, 5]) as s(k) where len(ws) >= k),
f as (select lang, k, g, count(*)::hugeint as f from g group by all having count(*) >= 100),
x as (select a.lang, a.g, a.f as a, c.n, l.f as l, r.f as r, 1000 * a.f * c.n // (l.f * r.f) as score, s.k as cut
      from f a, unnest([1, 2, 3, 4]) as s(k), f l, f r, c where a.k > s.k and l.lang = a.lang and r.lang = a.lang and c.lang = a.lang and l.g = a.g[1:s.k] and r.g = a.g[s.k + 1:]),
b as (select *, row_number() over (partition by lang, g order by score, cut) as o from x),
h as (select lang, sub, max(f) as longer from (select lang, f, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda i: g[i:i + m - 1])))) as sub from f where k > 2) group by all),
y as (select b.lang, array_to_string(b.g, ' ') as phrase, a, l, r, n, score from b left join h on h.lang = b.lang and h.sub = b.g where o = 1 and coalesce(longer < a, true)),
z as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from y)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from z where rank <= 2000""",
}
