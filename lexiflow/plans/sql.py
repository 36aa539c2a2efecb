"""The scores and metrics once more, as SQL for another engine: an independent check of results."""

from __future__ import annotations

from lexiflow.functions import lexicon as L

S = "[\\s\\x{00A0}]"
W = "[\\p{L}\\p{N}_-]+"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def n(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {q(pattern)}))"


def rm(text: str, pattern: str) -> str:
    return f"regexp_replace({text}, {q(pattern)}, '', 'g')"


def hits(text: str, phrases: list[str]) -> str:
    return "(" + " + ".join(f"(length({text}) - length(replace({text}, {q(p)}, ''))) / {len(p)}.0" for p in phrases) + ")"


def pick(ru: object, en: object) -> str:
    return f"(case when lang = 'ru' then {ru} else {en} end)"


def cap(x: str) -> str:
    return f"least(100, greatest(0, {x}))::bigint"


def whole(x: str) -> str:
    return f"floor(({x}) + 0.5)"


def variation(v: str) -> str:
    return f"(case when len({v}) >= 3 and list_avg({v}) <> 0 then sqrt(list_avg(list_transform({v}, lambda x: (x - list_avg({v})) * (x - list_avg({v}))))) / list_avg({v}) end)"


def dashes(text: str) -> str:
    doubled = f"regexp_replace({text}, '({S})', '\\1\\1', 'g')"
    return f"({n(text, '[—–]')} + {n(doubled, S + '-' + S)})"


def repeats(v: str) -> str:
    return f"list_sum(list_transform(list_filter(map_values(list_histogram(list_filter({v}, lambda x: x <> ''))), lambda c: c > 1), lambda c: c))"


def linked(words: list[str]) -> str:
    return "len(list_filter(heads, lambda h: " + " or ".join(f"starts_with(h, {q(p)})" for p in words) + "))"


_SPLIT = f"string_split(regexp_replace(t, '([.!?…]){S}+', '\\1' || chr(1), 'g'), chr(1))"
_PARTS = f"list_filter(list_transform(string_split_regex(t, '\\n{{2,}}'), lambda x: {rm('x', f'^{S}+|{S}+$')}), lambda x: x <> '')"
_LANG = f"case when {n('t', chr(92) + 'p{Cyrillic}')} > {n('t', chr(92) + 'p{Latin}')} then 'ru' else 'en' end as lang"
_HEADS = f"list_transform(ss, lambda s: left({rm('lower(s)', '^[^' + chr(92) + 'p{L}]+')}, 40)) as heads"
_LENS = f"list_filter(list_transform(ss, lambda s: {n('s', W)}), lambda x: x > 0) as lens"
_RANGE, _RANGE_ANY = f"[0-9]{S}*[—–]{S}*[0-9]", f"[0-9]{S}*[—–-]{S}*[0-9]"

_BASE = f"""with d as (select doc_id, coalesce(text, '') as t from documents),
s as (select doc_id, t, lower(t) as lo, {_LANG}, list_filter({_SPLIT}, lambda x: regexp_matches(x, '[^\\s\\x{{00A0}}]')) as ss, {_PARTS} as ps from d),
b as (select *, {_HEADS}, {_LENS}, len(ss) as n, {n("t", W)} as w, {rm("t", _RANGE)} as nr, {rm("t", _RANGE_ANY)} as na,
  list_transform(ps, lambda p: {n("p", W)}) as pl, list_transform(ss, lambda s: lower(regexp_extract(s, '[\\p{{L}}\\p{{N}}-]+'))) as op from s)"""


def _flat() -> str:
    marks = f"({n('na', '[:;()?!]')} + {n('na', '[«»' + chr(34) + '“”]')} // 2)"
    gap = lambda f, x: f"greatest(0.0, {f} - {x}) / {f}"
    pf, lf = (pick(f["ru"], f["en"]) for f in (L.MARK_FLOOR, L.LONG_FLOOR))
    long = f"(len(list_filter(ss, lambda s: {n('s', W)} >= 35)) / n::double)"
    return f"case when n >= 4 then {cap(whole(f'50 * {gap(pf, f'({marks} / n::double)')} + 50 * {gap(lf, long)}'))} else 0 end::bigint"


def score_sql() -> str:
    allow = f"greatest(1, {whole('n * ' + pick(L.DASH_RATE['ru'], L.DASH_RATE['en']))})"
    free = f"greatest(1, {whole('n * ' + pick(L.DISCOURSE_RATE['ru'], L.DISCOURSE_RATE['en']))})"
    strong = pick(f"greatest(0, {n('t', '(?i)' + L.ANTITHESIS_STRONG['ru'])} - 1)", n("t", "(?i)" + L.ANTITHESIS_STRONG["en"]))
    weak = pick("0", f"greatest(0, {n('t', '(?i)' + L.ANTITHESIS_WEAK['en'])} - 1)")  # the Russian form needs lookaround
    cols = {
        "em_dash": cap(f"({dashes('nr')} - {allow}) * 50"),
        "burstiness": cap(f"coalesce({whole(f'greatest(0.0, (0.55 - {variation("lens")}) / 0.55) * 100')}, 0)"),
        "cliche": cap(whole(pick(hits("lo", L.CLICHE_RU), hits("lo", L.CLICHE_EN)) + " * 20")),
        "antithesis": cap(f"{strong} * 45 + {weak} * 30"),
        "flatness": _flat(),
        "discourse": f"case when n > 0 then {cap(f'({pick(linked(L.DISCOURSE_RU), linked(L.DISCOURSE_EN))} - {free}) * 35')} else 0 end::bigint",
        "opener_repeat": f"case when n >= 3 then {cap(whole(f'greatest(0.0, coalesce({repeats("op")}, 0) / n::double - {pick(L.OPENER_RATE["ru"], L.OPENER_RATE["en"])}) * 300'))} else 0 end::bigint",
        "hedge": f"case when w > 0 then {cap(whole(f'greatest(0.0, {pick(hits("lo", L.HEDGE_RU), hits("lo", L.HEDGE_EN))} * 100 / w - {pick(L.HEDGE_RATE["ru"], L.HEDGE_RATE["en"])}) * 35'))} else 0 end::bigint",
        "paragraphs": f"case when len(pl) >= 3 and len(list_filter(pl, lambda x: x < 40)) = 0 and {variation('pl')} < 0.3 then {cap(whole(f'(0.3 - {variation("pl")}) / 0.3 * 100'))} else 0 end::bigint",
    }
    listed = ",\n".join(f"{c} as {k}" for k, c in cols.items())
    total = " + ".join(f"{k} * {w}::double" for k, w in L.WEIGHTS.items())
    return f"""{_BASE},
c as (select doc_id, lang as language, w::bigint as n_words, n::bigint as n_sentences, {dashes("nr")}::bigint as n_dashes,
{listed} from b)
select *, greatest({whole(total)}::bigint, antithesis) as score from c"""


def metric_sql() -> str:
    flat = _BASE.replace("list_filter(" + _SPLIT, f"list_filter(list_transform({_SPLIT.replace('regexp_replace(t,', 'regexp_replace(regexp_replace(t, ' + q(chr(92) + 'n+') + ', ' + q(' ') + ', ' + q('g') + '),')}, lambda x: {rm('x', f'^{S}+|{S}+$')})", 1)
    flat = flat.replace("list_transform(ss, lambda s: lower(regexp_extract(s, '[\\p{L}\\p{N}-]+'))) as op", "list_transform(ss, lambda s: array_to_string(regexp_extract_all(lower(s), '[\\p{L}\\p{N}-]+')[1:2], ' ')) as op, regexp_extract_all(lo, '[\\p{L}\\p{N}_-]+') as ws")
    shaped = lambda p: f"len(list_filter(regexp_extract_all(lo, {q(W)}), lambda x: regexp_matches(x, {q('^(?:' + p + ')$')})))"
    # what bounds a word is doubled, so that one place can end a match and begin the next
    apart = "regexp_replace(lo, '([^\\p{L}\\p{N}_-])', '\\1\\1', 'g')"
    bounded = lambda p: n(apart, "(?:^|[^\\p{L}\\p{N}_-])(?:" + p.replace("\\s", "[\\s\\x{00A0}]") + ")(?:$|[^\\p{L}\\p{N}_-])")
    per = lambda x, base: f"(case when {base} > 0 then ({x}) / {base}::double else 0.0 end)"
    inv = f"({n('na', '[:;(?!]')} + {n('na', '[«»' + chr(34) + '“”]')} // 2)"
    cols = {
        "sentenceCv": variation("lens"),
        "shortPerParagraph": per("len(list_filter(lens, lambda x: x < 6))", "len(ps)"),
        "discourseShare": per(pick(linked(L.DISCOURSE_RU), linked(L.DISCOURSE_EN)), "n"),
        "hedgeDensity": per(pick(hits("lo", L.HEDGE_RU), hits("lo", L.HEDGE_EN)) + " * 100", "w"),
        "nominalizationDensity": per(pick(*(f"({shaped(L.NOMINAL[k])} + {bounded(L.PASSIVE[k])})" for k in ("ru", "en"))) + " * 100.0", "w"),
        "paragraphCv": variation("pl"),
        "openerRepeat": per(f"coalesce({repeats('op')}, 0)", "n"),
        "ngramRepeat": "coalesce(r.share, 0.0)",
        "abstractShare": per(pick(shaped(L.ABSTRACT["ru"]), shaped(L.ABSTRACT["en"])), "w"),
        "dashShare": per(dashes("nr"), f"({dashes('nr')} + {n('nr', '[,:;(]')})"),
        "punctInventory": per(inv, "n"),
        "longSentences": per("len(list_filter(lens, lambda x: x >= 35))", "len(lens)"),
        "triadShare": per(f"len(list_filter(ss, lambda s: regexp_matches(s, {q('(?i)[^,;:()]{3,},[^,;:()]{3,},' + S + '*(?:and|or|и|или|а также)' + S)})))", "n"),
    }
    listed = ",\n".join(f'({c})::double as "{k}"' for k, c in cols.items())
    return f"""{flat},
g as (select doc_id, i, len(ws) as total, array_to_string(ws[i:i + 3], ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 2)) as i from b where len(ws) >= 8)),
r as (select doc_id, count(distinct j) / max(total)::double as share from (select doc_id, total, unnest(range(i, i + 4)) as j from (select *, count(*) over (partition by doc_id, g) as c from g) where c > 1) group by doc_id)
select b.doc_id, lang as language, w::bigint as n_words, n::bigint as n_sentences,
{listed} from b left join r on r.doc_id = b.doc_id"""


def tall_sql(genre: str = "academic") -> str:
    """Tall metrics with statuses, by the zones of a genre."""
    names = list(L.ZONES["en"])
    num = lambda x: "null" if x is None else str(x)
    zones = ", ".join(f"({q(lang)}, {q(m)}, {num(a)}, {num(b)}, {num(c)})" for lang, t in (L.ZONES if genre == "academic" else dict.fromkeys(L.ZONES, L.GENRE_ZONES[genre])).items() for m, (a, b, c) in t.items())
    listed = " union all ".join(f'select doc_id, language, n_words, n_sentences, {q(m)} as metric_id, "{m}" as value from m' for m in names)
    down, thin = (", ".join(map(q, x)) for x in (L.DOWNWARD, L.NEEDS_MATERIAL))
    return f"""with m as ({metric_sql()}), z(language, metric_id, low, high, overshoot) as (values {zones}), t as ({listed})
select t.doc_id, t.language, t.metric_id, value, low::double as low, high::double as high,
case when value is null or (t.metric_id in ({thin}) and (n_words < 120 or n_sentences < 5)) then 'unknown'
  when t.metric_id in ({down}) and value >= overshoot then 'high' when t.metric_id not in ({down}) and value > overshoot then 'overshoot'
  when value < low then 'low' when value > high then 'high' else 'ok' end as status
from t left join z on z.language = t.language and z.metric_id = t.metric_id"""
