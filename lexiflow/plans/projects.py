"""Queries of works, styles and tables, with SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiflow.operators import evidence, moves, projects, structure, styles, tables
from lexiflow.operators.projects import Outline, Section, TableForm
from lexiflow.plans.editing import list_items_of
from lexiflow.plans.registry import documents, query
from lexiflow.plans.sql import q
from lexiflow.session import scratch, stash
from lexiflow.sources import clipboard
from lexiflow.streaming import stores

#: The outline of the queries. Subsections hold words that the tables' languages have.
OUTLINE = Outline(
    (
        Section("summary", "Summary", ("executive summary",), ("With this",)),
        Section("market", "Market", ("market analysis",), ("Dans avec pour", "Nicht auch eine", "NPV of it"), (TableForm("Market volume", ("Year", "Volume")), TableForm("Rivals", ("Name", "Share")))),
        Section("plan", "Plan", (), ("That from which", "Para como"), (TableForm("Steps", ("Step", "Month")),)),
    ),
    contribution=Section("contribution", "Individual Contribution", (), ("Tasks", "Results")),
)
_TITLES = ["Summary", "executive summary", "Market", "Market analysis.", "Plan", "Notes", "Remarks", "Conclusion", "References", "Individual Contribution", "Appendix B", "Contents"]


def _works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as works: their fields come from ids and first turns."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    own = turns.groupBy(F.col("conv_id").alias("project_id")).agg(F.max(F.when(F.col("turn") == 0, F.substring("text", 1, 30))).alias("opening"))
    i = F.col("project_id")
    member = lambda k: F.struct(F.concat(F.lit("Member "), k.cast("string")).alias("name"), F.when((i + k) % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("G"), k.cast("string"))).alias("group"))
    team = F.when(i % 3 > 0, F.transform(F.sequence(F.lit(1).cast("long"), i % 3), member)).otherwise(F.array().cast("array<struct<name: string, group: string>>"))
    return own.select(
        i,
        F.when(i % 7 > 0, F.col("opening")).alias("topic"),
        F.when(i % 2 > 0, F.concat(F.lit("Programme "), (i % 2).cast("string"))).alias("programme"),
        team.alias("team"),
        F.when(i % 5 > 0, F.concat(F.lit("Dr "), (i % 11).cast("string"))).alias("supervisor"),
        (F.lit(2000) + i % 30).cast("string").alias("year"),
        F.when(i % 4 > 0, F.substring("opening", 1, 12)).alias("goal"),
        F.when(i % 3 > 0, F.lit("  the whole ")).alias("object"),
        F.lit(None).cast("string").alias("scope"),
        F.lit("").alias("methods"),
    )


_WORKS_SQL = """
works as (select conv_id as project_id, max(case when turn = 0 then left(text, 30) end) as opening from conversations group by conv_id),
wk as (select project_id, case when project_id % 7 > 0 then opening end as topic, case when project_id % 2 > 0 then 'Programme ' || project_id % 2 end as programme, project_id % 3 as members,
  case when project_id % 5 > 0 then 'Dr ' || project_id % 11 end as supervisor, (2000 + project_id % 30)::varchar as year,
  case when project_id % 4 > 0 then left(opening, 12) end as goal, case when project_id % 3 > 0 then 'the whole' end as object from works)"""


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as parts: a heading each, by a rule, and their lines as blocks."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("project_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("text", F.lit("")).alias("text"))
    nth = ((F.col("project_id") * 3 + F.col("turn") * 5) % len(_TITLES)).cast("int")
    level = F.when(F.col("turn") % 5 == 4, 2).otherwise(1)
    kind = F.when(nth == 10, F.lit("appendix")).otherwise(F.lit("section"))
    none = F.lit(None).cast("string")
    heads = turns.select("project_id", (F.col("turn") * 1000).alias("pos"), F.lit("heading").alias("type"), kind.alias("kind"), level.alias("level"), F.get(F.array(*map(F.lit, _TITLES)), nth).alias("title"), none.alias("text"))
    lines = turns.select("project_id", "turn", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    m = F.length("line") % 9
    kind = F.when(m == 0, "docTable").when(m == 1, "caption").when(m == 2, "heading").when(m == 3, "list").otherwise("paragraph")
    titled = m.isin(1, 2)
    body = lines.select(
        "project_id",
        (F.col("turn") * 1000 + 1 + F.col("i")).alias("pos"),
        kind.alias("type"),
        F.when(m == 1, F.when(F.col("i") % 2 == 0, "table").otherwise("figure")).when(m == 2, F.lit("section")).alias("kind"),
        F.when(m == 2, (F.lit(2) + F.col("i") % 3).cast("int")).alias("level"),
        F.when(titled, F.when(F.col("i") % 4 == 3, F.concat(F.lit("https://x.org "), F.col("line"))).otherwise(F.col("line"))).alias("title"),
        F.when(~titled, F.col("line")).alias("text"),
    )
    return heads.unionByName(body).withColumns({"structural": F.lit(False), "retain": (F.col("type") == "caption") & (F.col("pos") % 7 == 0), "number": F.when((F.col("type") == "caption") & (F.col("pos") % 7 == 0), F.lit("9.9"))})


_APART = r"(?i)^(?:individual\s+contribution|conclusion|references|bibliography|appendix|contents)"
_KEY = r"trim(regexp_replace(lower(coalesce(title, '')), '[\s\p{P}]+', ' ', 'g'))"
_BLOCKS_SQL = f"""
turns as (select conv_id as project_id, turn::bigint as turn, coalesce(text, '') as text, (conv_id * 3 + turn * 5) % {len(_TITLES)} as nth from conversations),
lines as (select project_id, turn, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i from turns),
b0 as (select project_id, turn * 1000 as pos, 'heading' as type, case when nth = 10 then 'appendix' else 'section' end as kind, case when turn % 5 = 4 then 2 else 1 end as level,
    [{', '.join(map(q, _TITLES))}][nth + 1] as title, null as text from turns
  union all select project_id, turn * 1000 + 1 + i, case length(line) % 9 when 0 then 'docTable' when 1 then 'caption' when 2 then 'heading' when 3 then 'list' else 'paragraph' end,
    case length(line) % 9 when 1 then case when i % 2 = 0 then 'table' else 'figure' end when 2 then 'section' end, case when length(line) % 9 = 2 then 2 + i % 3 end,
    case when length(line) % 9 in (1, 2) then case when i % 4 = 3 then 'https://x.org ' || line else line end end, case when length(line) % 9 not in (1, 2) then line end from lines),
blocks as (select *, type = 'caption' and pos % 7 = 0 as retain, case when type = 'caption' and pos % 7 = 0 then '9.9' end as number, {_KEY} as key from b0)"""

_NUMBERS = """(select string_agg((select count(*) filter (k.level = j) from heads k where k.project_id = h.project_id and k.pos > start and k.pos <= h.pos)
      + (select (arg_min(k.level, k.pos) > j)::int from heads k where k.project_id = h.project_id and k.pos > start), '.' order by j)
    from (select j, coalesce((select max(k.pos) from heads k where k.project_id = h.project_id and k.pos < h.pos and k.level < j), -1) as start from unnest(range(1, h.level + 1)) as s(j)))"""


@query(f"""with {_BLOCKS_SQL.strip()},
heads as (select project_id, pos, level from blocks where type = 'heading' and kind <> 'appendix'),
n as (select project_id, pos, {_NUMBERS} as number from heads h),
c as (select project_id, pos, row_number() over (partition by project_id, kind order by pos)::varchar as number from blocks where type = 'caption' and not retain)
select b.project_id, b.pos, b.type, coalesce(n.number, c.number, b.number) as number from blocks b left join n using (project_id, pos) left join c using (project_id, pos)""")
def renumbered_blocks(spark, sf_dir):
    """Headings by level and captions by kind, numbered through each work."""
    return projects.renumbered(_blocks(spark, sf_dir).withColumn("numbered", F.lit(True))).select("project_id", "pos", "type", "number")


_PARTS_RULE = "['summary', 'market', 'plan', 'contribution', 'conclusion', 'references', 'appendix', 'elsewhere']"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as parts of sections, by a rule."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    section = F.get(F.array(*map(F.lit, _PARTS_RULE[2:-2].split("', '"))), ((F.col("conv_id") + F.col("turn")) % 8).cast("int"))
    long = F.col("turn") % 3 == 0
    text = F.when(section == "references", F.regexp_replace("text", "\n", "\n\n- ")).otherwise(F.col("text"))
    return turns.select(F.col("conv_id").alias("project_id"), F.col("turn").alias("part_id"), F.col("turn").cast("long").alias("pos"), section.alias("section_id"), F.when(long, F.concat(F.lit("Part "), F.col("turn").cast("string"))).alias("title"), text.alias("text"))


_PARTS_SQL = rf"""
p as (select conv_id as project_id, turn, {_PARTS_RULE}[(conv_id + turn) % 8 + 1] as section_id, case when turn % 3 = 0 then 'Part ' || turn else '' end as title, text from conversations),
clean as (select project_id, turn, case when section_id = 'elsewhere' then 'unassigned' else section_id end as section_id, title,
  regexp_replace(regexp_replace(coalesce(case when section_id = 'references' then replace(text, chr(10), chr(10) || chr(10) || '- ') else text end, ''), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') as text from p),
parts as (select * from clean where text <> ''),
en as (select project_id, turn, unnest(list_filter(list_transform(string_split_regex(text, '\n{{2,}}'), lambda e: regexp_replace(regexp_replace(e, '\s*\n\s*', ' ', 'g'), '^\s+|\s+$', '', 'g')), lambda e: e <> '')) as entry from parts where section_id = 'references'),
eo as (select project_id, turn, regexp_replace(entry, '^([-*•▪◦]|[0-9]+[.)])\s+', '') as entry, row_number() over (partition by project_id order by turn, i)::bigint as number
  from (select *, row_number() over () as i from en))"""


@query(f"with {_PARTS_SQL.strip()} select project_id, turn as part_id, number, entry from eo")
def numbered_references(spark, sf_dir):
    """The references of each work's parts, numbered through."""
    parts = projects.sanitized(_parts(spark, sf_dir), ["references"]).where("section_id = 'references'")
    return projects.numbered_references(parts).drop("pos")


_PLACES = [("summary", 1, 1, "1. Summary"), ("market", 1, 2, "2. Market"), ("plan", 1, 3, "3. Plan"), ("contribution", 1, 4, "4. Individual Contribution"), ("contribution", 2, 1, "Individual Contribution"), ("conclusion", 2, 2, "Conclusion"),
           ("references", 2, 3, "References"), ("appendix", 3, 1, "Appendix A. Supporting materials"), ("unassigned", 4, 1, "Material to classify")]


@query(f"""with {_WORKS_SQL.strip()}, {_PARTS_SQL.strip()},
ent as (select project_id, turn, string_agg(number || '. ' || entry, chr(10) order by number) as entries from eo group by all),
shown as (select parts.project_id, section_id, parts.turn as turn, array_to_string(list_filter([case when section_id = 'unassigned' then '' else title end, case when section_id = 'references' then coalesce(entries, '') else text end], lambda x: x <> ''), chr(10) || chr(10)) as text
  from parts left join ent on ent.project_id = parts.project_id and ent.turn = parts.turn),
sec as (select project_id, section_id, string_agg(text, chr(10) || chr(10) order by turn) as body from shown group by all),
place(section_id, zone, nr, title) as (values {', '.join(f"({q(a)}, {b}, {c}, {q(t)})" for a, b, c, t in _PLACES)}),
g as (select sec.*, zone, nr, title, case when goal is not null or object is not null then 'Project context: ' || array_to_string(list_filter(['Project goal: ' || trim(goal), 'Object / organization: ' || object], lambda x: x is not null), '. ') || '.' end as context
  from sec join place using (section_id) join wk on wk.project_id = sec.project_id),
r as (select project_id, section_id, zone, nr, 0 as part, 'heading' as kind, title as text from g
  union all select project_id, section_id, zone, nr, 1, 'context', context from g where zone = 1 and nr = 1 and context is not null union all select project_id, section_id, zone, nr, 2, 'body', body from g)
select project_id, row_number() over (partition by project_id order by zone, nr, part)::bigint as pos, kind, section_id, text from r""")
def work_source_blocks(spark, sf_dir):
    """The text of each work from its parts, in the outline's order."""
    return projects.source_blocks(_works(spark, sf_dir), _parts(spark, sf_dir), OUTLINE)


@query(f"""with {_WORKS_SQL.strip()}, m as (select project_id, unnest(range(1, members + 1)) as k from wk)
select project_id, 'topic' as field from wk where coalesce(trim(topic), '') = '' union all select project_id, 'team' from wk where members = 0
union all select project_id, 'group ' || k from m where (project_id + k) % 4 = 0 union all select project_id, 'supervisor' from wk where supervisor is null union all select project_id, 'programme' from wk where programme is null""")
def work_blank_fields(spark, sf_dir):
    """What only people can fill in, and nobody did."""
    return projects.blank_fields(_works(spark, sf_dir))


def _styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as styles of their language's set, each based on another by a rule that makes chains and cycles."""
    d = documents(spark, sf_dir).select("lang", F.col("doc_id").alias("style_id"), "n_chars", "source")
    return d.withColumn("based_on", F.when(F.col("style_id") % 13 > 0, F.when(F.col("style_id") % 3 > 0, F.col("style_id") + F.col("n_chars") % 7 - 3).otherwise((F.col("style_id") * 48271 + F.col("n_chars")) % 997)))


_STYLES_SQL = "styles as (select lang, doc_id as style_id, case when doc_id % 13 > 0 then case when doc_id % 3 > 0 then doc_id + n_chars % 7 - 3 else (doc_id * 48271 + n_chars) % 997 end end as based_on, n_chars, source from documents)"
_CHAINS_SQL = f"""{_STYLES_SQL},
walk(lang, style_id, path, here) as (select lang, style_id, [style_id], style_id from styles
  union all select w.lang, w.style_id, list_append(w.path, s.based_on), s.based_on from walk w join styles s on s.lang = w.lang and s.style_id = w.here join styles b on b.lang = s.lang and b.style_id = s.based_on where not list_contains(w.path, s.based_on)),
longest as (select lang, style_id, arg_max(path, len(path)) as path from walk group by all),
chains as (select lang, style_id, unnest(path) as ancestor, unnest(range(len(path))) as distance from longest)"""


@query(f"with recursive {_CHAINS_SQL} select * from chains")
def style_chains(spark, sf_dir):
    """Every style of each style's chain, up to where a style would come twice."""
    return styles.style_chains(_styles(spark, sf_dir), ("lang",))


@query(f"""with recursive {_CHAINS_SQL}
select c.lang, c.style_id, min(c.distance) + 1 as length from chains c join styles s on s.lang = c.lang and s.style_id = c.ancestor where s.based_on = c.style_id group by all""")
def style_cycles(spark, sf_dir):
    """The styles that are based on themselves over others."""
    return styles.style_cycles(_styles(spark, sf_dir), ("lang",))


@query(f"""with recursive {_CHAINS_SQL},
props as (select lang, style_id, 'size' as name, n_chars::varchar as value from styles where n_chars % 5 = 0 union all select lang, style_id, 'font', source from styles where n_chars % 7 = 0),
near as (select c.lang, c.style_id, p.name, c.distance, p.value, c.ancestor, row_number() over (partition by c.lang, c.style_id, p.name order by c.distance) as k from chains c join props p on p.lang = c.lang and p.style_id = c.ancestor)
select lang, style_id, name, value, ancestor as origin from near where k = 1""")
def style_properties(spark, sf_dir):
    """What each style's properties come to: the nearest style of its chain decides."""
    s = _styles(spark, sf_dir)
    said = s.select("lang", "style_id", F.lit("size").alias("name"), F.col("n_chars").cast("string").alias("value"), (F.col("n_chars") % 5 == 0).alias("has"))
    said = said.unionByName(s.select("lang", "style_id", F.lit("font").alias("name"), F.col("source").alias("value"), (F.col("n_chars") % 7 == 0).alias("has")))
    return styles.inherited(styles.style_chains(s, ("lang",)), said.where("has").drop("has"), ("lang",))


def _planned_sql() -> str:
    """The outline's own rows as SQL values: zone, major, minor, sub, type, kind, level, title, text, numbered, need, place, subsection or form, how many words it takes."""
    rows = [(1, 0, 0, 0, "heading", "section", 1, "Contents", None, False, "", "", "", 0), (1, 0, 0, 1, "toc", None, None, None, None, None, "", "", "", 0)]
    for k, s in enumerate(OUTLINE.sections, 1):
        rows += [(2, k, 0, 0, "heading", "section", 1, s.title, None, True, "", "", "", 0), (2, k, 1, 0, "paragraph", None, None, None, "—", None, "unfilled", f"section:{k}", "", 0)]
        for i, t in enumerate(s.subsections):
            rows += [(2, k, 2, 2 * i, "heading", "section", 2, t, None, True, "uncovered", f"section:{k}", t, 0), (2, k, 2, 2 * i + 1, "paragraph", None, None, None, "—", None, "uncovered", f"section:{k}", t, 0)]
        for i, t in enumerate(s.tables):
            rows += [
                (2, k, 3, 3 * i, "caption", "table", None, t.title, None, None, "tables", f"section:{k}", "", i),
                (2, k, 3, 3 * i + 1, "sourceNote", None, None, None, OUTLINE.note, None, "tables", f"section:{k}", "", i),
                (2, k, 3, 3 * i + 2, "docTable", None, None, None, "\t".join(t.columns), None, "tables", f"section:{k}", "", i),
            ]
    rows += [(4, 0, 0, 0, "heading", "section", 1, "Individual Contribution", None, False, "", "", "", 0)]
    for k, s in enumerate(OUTLINE.closing, 1):
        rows += [(5, k, 0, 0, "heading", "section", 1, s.title, None, False, "", "", "", 0), (5, k, 1, 0, "paragraph", None, None, None, "—", None, "unfilled", f"closing:{s.section_id}", "", 0)]
    rows += [(6, 0, 0, 0, "heading", "section", 1, OUTLINE.leftover, None, False, "filled", "preamble", "", 0)]
    cell = lambda v: "null" if v is None else q(v) if isinstance(v, str) else str(v).lower()
    return ", ".join(f"({', '.join(map(cell, r))})" for r in rows)


_WORDS_SQL = ", ".join(f"({k}, {q(t)}, {q(w)})" for k, s in enumerate(OUTLINE.sections, 1) for t in s.subsections for w in projects.keywords(t))
_FORMS_SQL = ", ".join(f"({k}, {i}, {q(t.title)})" for k, s in enumerate(OUTLINE.sections, 1) for i, t in enumerate(s.tables, 1))
_BLANK = projects.BLANK

_ASSEMBLED_SQL = f"""{_WORKS_SQL.strip()}, {_BLOCKS_SQL.strip()},
tops as (select *, coalesce(type = 'heading' and (level = 1 or kind = 'appendix' or regexp_matches(title, {q(_APART)}) or key in ('summary', 'market', 'plan')), false) as top, coalesce(regexp_matches(title, {q(_APART)}), false) as apart,
  case when key in ('summary', 'executive summary') then 1 when key in ('market', 'market analysis') then 2 when key = 'plan' then 3 end as section from blocks),
heads as (select *, case when not top then null when kind = 'appendix' then 7 when section is not null then 2 when apart and key = 'individual contribution' then 4 when apart and key in ('conclusion', 'references') then 5 when apart then -1 else 3 end as z from tops),
seg as (select *, last_value(z ignore nulls) over w as z0, last_value(case when top then coalesce(case when z = 2 then section when z = 5 then case key when 'conclusion' then 1 else 2 end end, 0) end ignore nulls) over w as m0,
  last_value(case when top then case z when 2 then 'section:' || section when 4 then 'contribution' when 5 then 'closing:' || key else '' end end ignore nulls) over w as p0, last_value(case when top then pos end ignore nulls) over w as s0
  from heads window w as (partition by project_id order by pos rows between unbounded preceding and current row)),
own as (select *, coalesce(z0, 6) as zone, coalesce(m0, 0) as major, case when z0 is null then 'preamble' else nullif(p0, '') end as place, max(s0) over (partition by project_id, p0) as last from seg),
live as (select * from own where zone <> -1 and not (zone in (4, 5) and s0 < last)),
body as (select *, coalesce(type in ('paragraph', 'list', 'table', 'image', 'docTable') and text is distinct from '—', false) as holds,
  coalesce(place = 'closing:references' and type = 'heading' and regexp_matches(title, '(?i)(?:https?://|\\b(?:doi|isbn|(?:19|20)[0-9]{{2}})\\b)'), false) as entry from live),
filled as (select distinct project_id, place from body where not top and (holds and place is not null or entry)),
tcount as (select project_id, major, count(*) as n from body where not top and zone = 2 and type in ('table', 'docTable') group by all),
hits as (select b.project_id, w.major, w.sub, count(distinct w.word) as n from body b join (values {_WORDS_SQL}) w(major, sub, word) on b.major = w.major and contains(lower(case when b.type = 'heading' then b.title else b.text end), w.word) where not b.top and b.zone = 2 group by all),
least as (select major, sub, (count(*) + 1) // 2 as least from (values {_WORDS_SQL}) w(major, sub, word) group by all),
planned(zone, major, minor, sub, type, kind, level, title, text, numbered, need, place, subsection, nth) as (values {_planned_sql()}),
gen as (select wk.project_id, p.zone, p.major, p.minor, 0::bigint as nr, p.sub, p.type, p.kind, p.level, p.title, p.text, p.numbered, null as number,
    case need when 'unfilled' then 'unfilled:' || p.place when 'uncovered' then 'uncovered:' || p.place || ':' || coalesce(p.title, '') when 'tables' then 'tables:' || p.place || ':' || coalesce(p.title, '') end as stub
  from wk cross join planned p left join filled f on f.project_id = wk.project_id and f.place = p.place left join tcount t on t.project_id = wk.project_id and t.major = p.major
    left join hits h on h.project_id = wk.project_id and h.major = p.major and h.sub = p.subsection left join least l on l.major = p.major and l.sub = p.subsection
  where need = '' or need = 'unfilled' and f.place is null or need = 'filled' and f.place is not null or need = 'uncovered' and coalesce(h.n, 0) < l.least or need = 'tables' and coalesce(t.n, 0) <= p.nth),
team as (select project_id, unnest(range(1, members + 1)) as k from wk),
label as (select project_id, k, 'Member ' || k as name, 'Member ' || k || ', ' || case when (project_id + k) % 4 = 0 then {q(_BLANK)} else 'G' || k end as label from team),
named as (select wk.*, l.people, l.listed from wk left join (select project_id, string_agg(label, chr(10) order by k) as people, string_agg(k || '. ' || label, chr(10) order by k) as listed from label group by all) l using (project_id)),
front as (select project_id, unnest([{{'sub': 0, 'type': 'plain', 'title': null, 'text': coalesce(nullif(trim(regexp_replace(topic, '^\\s+|\\s+$', '', 'g')), ''), {q(_BLANK)})}},
  {{'sub': 1, 'type': 'plain', 'title': null, 'text': 'educational programme ' || coalesce(programme, {q(_BLANK)})}}, {{'sub': 2, 'type': 'plain', 'title': null, 'text': 'Project completed by:' || chr(10) || coalesce(people, {q(_BLANK)} || ', group')}},
  {{'sub': 3, 'type': 'plain', 'title': null, 'text': 'Course project supervisor:' || chr(10) || coalesce(supervisor, 'degree, academic title, position, full name')}}, {{'sub': 4, 'type': 'plain', 'title': null, 'text': year}},
  {{'sub': 5, 'type': 'heading', 'title': 'Team members', 'text': null}}, {{'sub': 6, 'type': case when listed is null then 'paragraph' else 'list' end, 'title': null, 'text': coalesce(listed, '—')}}]) as r from named),
who as (select project_id, k - 1 as k, name from label union all select project_id, 0, {q(_BLANK)} from wk where members = 0),
contrib as (select w.project_id, w.k, s.nr, s.level, case s.level when 2 then 'Individual Contribution: ' || w.name else s.title end as title, s.text from who w cross join
  (values (0, 2, null, null), (1, 3, 'Tasks', null), (2, null, null, '—'), (3, 3, 'Results', null), (4, null, null, '—')) s(nr, level, title, text)
  where not exists (select 1 from filled f where f.project_id = w.project_id and f.place = 'contribution')),
kept as (select b.*, row_number() over t as dummy, sum((b.type in ('table', 'docTable'))::int) over t as nth, lag(b.type) over t as btype, lag(b.kind) over t as bkind
  from body b left join filled f on f.project_id = b.project_id and f.place = b.place join wk on wk.project_id = b.project_id
  where (not b.top or b.zone in (3, 7)) and (b.zone in (3, 7) or f.place is not null) window t as (partition by b.project_id, b.zone, b.major order by b.pos)),
bare as (select k.*, form from kept k join (values {_FORMS_SQL}) f(major, nth, form) on f.major = k.major and f.nth = k.nth where zone = 2 and type in ('table', 'docTable') and not coalesce(btype = 'caption' and bkind = 'table', false)),
every as (select project_id, zone, major, minor, nr, sub, type, kind, level, title, text, numbered, false as retain, number, true as generated, stub from gen
  union all select project_id, 0, 0, 0, 0, r.sub, r.type, case when r.type = 'heading' then 'section' end, case when r.type = 'heading' then 1 end, r.title, r.text, false, false, null, true, null from front
  union all select project_id, 4, 0, 1, k, nr, case when level is null then 'paragraph' else 'heading' end, case when level is not null then 'section' end, level, title, text, false, false, null, true, case when level is null then 'unfilled:contribution' end from contrib
  union all select project_id, zone, major, 1, pos, 2, case when entry then 'paragraph' else type end, kind, level, case when not entry then title end, case when entry then title else text end, type = 'heading' and not entry and zone <> 4, retain, number, false, null from kept
  union all select project_id, zone, major, 1, pos, 0, 'caption', 'table', null, form, null, false, false, null, true, null from bare
  union all select project_id, zone, major, 1, pos, 1, 'sourceNote', null, null, null, {q(OUTLINE.note)}, false, false, null, true, null from bare),
doc as (select *, row_number() over (partition by project_id order by zone, major, minor, nr, sub)::bigint as pos from every),
nh as (select project_id, pos, level from doc where type = 'heading' and numbered and kind is distinct from 'appendix'),
n as (select project_id, pos, {_NUMBERS.replace("heads k", "nh k")} as hn from nh h),
c as (select project_id, pos, row_number() over (partition by project_id, kind order by pos)::varchar as cn from doc where type = 'caption' and not retain)
select d.project_id, d.pos, zone::integer as zone, type, kind, level::integer as level, coalesce(hn, cn, number) as number, title, text, generated, stub from doc d left join n using (project_id, pos) left join c using (project_id, pos)"""


@query(f"with {_ASSEMBLED_SQL}")
def assembled_works(spark, sf_dir):
    """Each work as a whole document: front matter, sections with stubs for what is missing, closing parts, appendices; numbered through."""
    return projects.assembled(_works(spark, sf_dir), _blocks(spark, sf_dir), OUTLINE)


def _revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as events on the versions of ten texts: saves, some removals of an earlier version, and a clearing."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    key = (F.col("conv_id") % 10).cast("string")
    order = Window.partitionBy("key").orderBy("conv_id", "turn")
    rows = turns.select(key.alias("key"), "conv_id", "turn", "role", F.substring("text", 1, 4).alias("text")).withColumns({"seq": F.row_number().over(order).cast("long"), "_old": F.lag("text", 3).over(order)})
    op = F.when((F.col("key") == "3") & (F.col("seq") == 17), "clear").when((F.col("conv_id") + F.col("turn")) % 6 == 0, "remove").otherwise("save")
    old = F.concat(F.lit("rev-"), (F.col("seq") - 3).cast("string"), F.lit("-"), F.length("_old").cast("string"))
    none = F.lit(None).cast("double")
    return rows.select("key", "seq", op.alias("op"), old.alias("id"), F.col("role").alias("label"), F.length("text").cast("long").alias("words"), none.alias("score"), none.alias("off_zone"), "text")


@query("""with recursive t as (select (conv_id % 10)::varchar as key, conv_id, turn, role, left(text, 4) as text from conversations),
s as (select *, row_number() over w as seq, lag(text, 3) over w as old from t window w as (partition by key order by conv_id, turn)),
e as (select key, seq, case when key = '3' and seq = 17 then 'clear' when (conv_id + turn) % 6 = 0 then 'remove' else 'save' end as op, 'rev-' || (seq - 3) || '-' || length(old) as id, role, text from s),
r as (select key, 0::bigint as seq, []::struct(id varchar, "at" bigint, label varchar, words bigint, text varchar)[] as v from (select distinct key from e)
  union all select r.key, e.seq, case op when 'clear' then [] when 'remove' then list_filter(v, lambda x: x.id is distinct from e.id) else
    list_prepend({'id': 'rev-' || e.seq || '-' || length(e.text), 'at': e.seq, 'label': e.role, 'words': length(e.text)::bigint, 'text': e.text}, list_filter(v, lambda x: x.text <> e.text))[1:20] end
  from r join e on e.key = r.key and e.seq = r.seq + 1),
z as (select key, arg_max(v, seq) as v from r group by key),
u as (select key, unnest(range(1, len(v) + 1)) as place, v from z)
select key, place::integer as place, v[place].id as id, v[place]."at" as "at", v[place].label as label, v[place].words as words, v[place].text as text from u""")
def revision_history(spark, sf_dir):
    """The versions that a store keeps of each text, merged in three batches, of which one comes twice."""
    events = stash(_revisions(spark, sf_dir))
    store = stores.Store(scratch(spark, "revisions"), stores.REVISION, stores.revision_step, buckets=4)
    for version, batch in ((0, "seq <= 20"), (1, "seq > 20 and seq <= 40"), (1, "seq > 20 and seq <= 40"), (2, "seq > 40")):
        stores.merge(store, events.where(batch), version)
    return stores.entries(spark, store).select("key", "place", "id", "at", "label", "words", "text")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as tables: a row a turn; the role reaches over two turns (over all where the id is a multiple of 5), a text over two columns at times."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    every, wide = F.col("conv_id") % 5 == 0, F.length("text") % 3 == 0
    first = F.when(every, F.col("turn") == 0).otherwise(F.col("turn") % 2 == 0)
    cell = lambda at, keep, cs, rs, text: F.when(keep, F.struct(F.lit(at).alias("at"), cs.alias("col_span"), rs.alias("row_span"), text.alias("text")))
    one = F.lit(1)
    cells = F.array(
        cell(0, first, one, F.when(every, 0).otherwise(2), F.col("role")),
        cell(1, F.lit(True), one, one, F.substring("text", 1, 5)),
        cell(2, F.lit(True), F.when(wide, 2).otherwise(1), F.lit(None).cast("int"), F.substring("text", 6, 5)),
        cell(3, ~wide, F.lit(None).cast("int"), one, F.substring("text", 11, 5)),
    )
    return turns.select("conv_id", F.col("turn").alias("row"), F.explode(F.filter(cells, lambda c: c.isNotNull())).alias("c")).select("conv_id", "row", "c.*")


@query("""with t as (select *, count(*) over (partition by conv_id) as n from conversations),
c as (select conv_id, turn, n, role, text, unnest(list_filter([0, 1, 2, 3], lambda a: case a when 0 then case when conv_id % 5 = 0 then turn = 0 else turn % 2 = 0 end when 3 then length(text) % 3 > 0 else true end)) as a from t),
d as (select *, conv_id % 5 > 0 and n % 2 = 1 as bad from c)
select conv_id, turn::integer as "row", a::integer as "at", case when not bad then a end::integer as "column", case when a = 2 and length(text) % 3 = 0 then 2 else 1 end::integer as col_span,
  case when a > 0 then 1 when conv_id % 5 > 0 then 2 when bad then 0 else n end::integer as row_span, case a when 0 then role when 1 then text[1:5] when 2 then text[6:10] else text[11:15] end as text, case when bad then 'overlap' end as problem from d""")
def table_grid(spark, sf_dir):
    """Cells that span rows and columns, with the columns they stand in; a table whose spans leave it is told."""
    return tables.placed(_cells(spark, sf_dir), ["conv_id"])


@query(f"""with recursive {_BLOCKS_SQL.strip()},
n as (select *, lag(type) over w as bt, lead(type) over w as nt from blocks window w as (partition by project_id order by pos)),
u as (select *, type = 'docTable' and coalesce(bt = 'caption' and lag(kind) over (partition by project_id order by pos) = 'table', false) as joins from n),
v as (select *, last_value(case when not joins then pos end ignore nulls) over (partition by project_id order by pos rows unbounded preceding) as unit from u),
k as (select project_id, unit, coalesce(max(case when type = 'docTable' then 'table' end), max(case when pos = unit and type = 'heading' then 'heading' end)) as kind from v group by all),
l as (select project_id, list(unit order by unit) as us, list(kind order by unit) as ks from k group by all),
m as (select project_id, unit, row_number() over (partition by project_id order by pos) as seq, case when pos % 3 = 0 then 1 else -1 end as d from v where type = 'docTable'),
r as (select project_id, 0::bigint as seq, us, ks from l union all
  select project_id, seq, case when ok then list_transform(us, lambda x, i: case i when a then us[b] when b then us[a] else x end) else us end, case when ok then list_transform(ks, lambda x, i: case i when a then ks[b] when b then ks[a] else x end) else ks end
  from (select *, b between 1 and len(us) and ks[b] is distinct from 'heading' as ok from (select r.project_id, m.seq, us, ks, list_position(us, m.unit) as a, list_position(us, m.unit) + m.d as b from r join m on m.project_id = r.project_id and m.seq = r.seq + 1))),
z as (select project_id, arg_max(us, seq) as us from r group by all)
select project_id, unnest(range(1, len(us) + 1)) as place, unnest(us)::bigint as unit from z""")
def moved_units(spark, sf_dir):
    """The order of each work's units after every table was moved up or down by a log."""
    blocks = _blocks(spark, sf_dir)
    tabled = moves.with_units(blocks, "project_id").where("type = 'docTable'")
    seq = F.row_number().over(Window.partitionBy("project_id").orderBy("pos"))
    log = tabled.select("project_id", seq.alias("seq"), F.lit("move").alias("op"), "unit", F.when(F.col("pos") % 3 == 0, 1).otherwise(-1).alias("direction"), F.lit(None).cast("string").alias("title"))
    done = moves.replayed(moves.unit_lists(blocks, "project_id"), log, "project_id")
    return done.select("project_id", F.posexplode("units").alias("place", "_u")).select("project_id", (F.col("place") + 1).cast("long").alias("place"), F.col("_u.unit").alias("unit"))


@query(f"""with {_BLOCKS_SQL.strip()},
c as (select project_id, pos, kind, case when pos % 7 = 0 then (pos % 5 + 1)::varchar when pos % 11 = 0 then '2.1' end as given from blocks where type = 'caption'),
f as (select project_id, kind, list(given::integer) filter (regexp_full_match(given, '[0-9]+')) as used, count(*) as n from c group by all),
g as (select c.*, sum((given is null)::int) over (partition by project_id, kind order by pos) as nth from c),
o as (select project_id, kind, list_filter(range(1, n + len(coalesce(used, [])) + 2), lambda x: not list_contains(coalesce(used, []), x)) as free from f)
select g.project_id, pos, g.kind, coalesce(given, free[nth::bigint]::varchar) as number from g join o on o.project_id = g.project_id and o.kind = g.kind""")
def caption_numbering(spark, sf_dir):
    """Captions without a number take the free ones in order; those that have one keep it."""
    captions = _blocks(spark, sf_dir).where("type = 'caption'")
    given = F.when(F.col("pos") % 7 == 0, (F.col("pos") % 5 + 1).cast("string")).when(F.col("pos") % 11 == 0, "2.1")
    return structure.number_captions(captions.select("project_id", "pos", "kind", given.alias("number")), "project_id")


_LISTED_SQL = r"""l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as x, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos from documents),
m as (select doc_id, pos, case pos % 5 when 0 then '- ' || x when 1 then (pos + 1) || ') ' || x when 2 then '  • ' || x when 3 then '-' || x else x end as x from l)"""


@query(rf"""with {_LISTED_SQL}, s as (select doc_id, pos, regexp_replace(x, '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g') as item from m)
select doc_id, pos::integer as pos, item from s where regexp_matches(item, '^(?:[-*•▪◦]|[0-9]+[.)])[\s\x{{00A0}}]')""")
def marked_list_items(spark, sf_dir):
    """The items of lists in documents whose lines were given marks by a rule, as the table has few of its own."""
    line = lambda x, i: F.when(i % 5 == 0, F.concat(F.lit("- "), x)).when(i % 5 == 1, F.concat((i + 1).cast("string"), F.lit(") "), x)).when(i % 5 == 2, F.concat(F.lit("  • "), x)).when(i % 5 == 3, F.concat(F.lit("-"), x)).otherwise(x)
    marked = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line), "\n")
    return list_items_of(documents(spark, sf_dir).withColumn("text", marked))


def _pastes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Conversations as pastes: users' turns as rich blocks, some of them pictures or gaps, assistants' as plain ones, and photos by a rule."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("paste_id"), "turn", "role", F.substring("text", 1, 20).alias("text"))
    i = F.col("paste_id")
    pastes = turns.select("paste_id").distinct().withColumn("has_html", i % 3 > 0)
    m = (i + F.col("turn")) % 4
    kind = F.when(m == 0, "imageMissing").when(m == 2, "image").otherwise("paragraph")
    none = F.lit(None).cast("string")
    shape = lambda df, t: df.select("paste_id", F.col("turn").alias("pos"), t.alias("type"), F.when(t == "paragraph", F.col("text")).alias("text"), F.when(t == "image", F.concat(F.lit("data:"), (F.col("turn") % 3).cast("string"))).alias("data_url"), none.alias("alt"))
    rich = shape(turns.where("role = 'user' and paste_id % 7 > 0"), kind)
    plain = shape(turns.where("role = 'assistant' and paste_id % 6 > 0"), F.lit("paragraph"))
    photos = pastes.select("paste_id", F.explode(F.sequence(F.lit(1), (i % 3).cast("int") + 1)).alias("nth")).where("nth <= paste_id % 4")
    return pastes, rich, plain, photos.select("paste_id", "nth", F.concat(F.lit("data:"), (F.col("nth") % 3).cast("string")).alias("data_url"), F.concat(F.lit("photo "), F.col("nth").cast("string")).alias("alt"))


_PASTES_SQL = """
p as (select distinct conv_id as paste_id, conv_id % 3 > 0 as has_html from conversations),
b as (select conv_id as paste_id, turn as pos, case when conv_id % 3 = 0 then 'paragraph' else case (conv_id + turn) % 4 when 0 then 'imageMissing' when 2 then 'image' else 'paragraph' end end as type, text[1:20] as text, 'data:' || turn % 3 as url
  from conversations where case when conv_id % 3 > 0 then role = 'user' and conv_id % 7 > 0 else role = 'assistant' and conv_id % 6 > 0 end),
f as (select paste_id, nth, 'data:' || nth % 3 as url, 'photo ' || nth as alt from (select paste_id, unnest(range(1, paste_id % 3 + 2)) as nth from p) where nth <= paste_id % 4),
c as (select p.paste_id, (select count(*) from b where b.paste_id = p.paste_id) as n, (select count(*) from b where b.paste_id = p.paste_id and type = 'imageMissing') as gaps, (select count(*) from f where f.paste_id = p.paste_id) as photos,
  (select count(*) from f where f.paste_id = p.paste_id and not exists (select 1 from b where b.paste_id = f.paste_id and b.type = 'image' and b.url = f.url)) as loose from p),
j as (select *, case when n = 0 and photos = 0 then 'nothing to read' when not (gaps = 1 and photos = 1) and n > 0 and loose > 0 then 'photos without a place' end as problem from c)"""


@query(f"""with {_PASTES_SQL.strip()}
select b.paste_id, b.pos::bigint as pos, case when type = 'imageMissing' and gaps = 1 and photos = 1 then 'image' else type end as type, case when type = 'paragraph' then text end as text,
  case when type = 'imageMissing' and gaps = 1 and photos = 1 then f.url when type = 'image' then b.url end as data_url, case when type = 'imageMissing' and gaps = 1 and photos = 1 then alt end as alt
from b join j on j.paste_id = b.paste_id and problem is null left join f on f.paste_id = b.paste_id and photos = 1
union all select f.paste_id, row_number() over (partition by f.paste_id order by nth), 'image', null, url, alt from f join j on j.paste_id = f.paste_id and problem is null and n = 0""")
def merged_pastes(spark, sf_dir):
    """The blocks of each paste, from the form that says most, photos in their places."""
    return clipboard.merged_pastes(*_pastes(spark, sf_dir))


@query(f"with {_PASTES_SQL.strip()} select paste_id, problem from j where problem is not null")
def paste_problems(spark, sf_dir):
    """The pastes that are refused, and why."""
    return clipboard.paste_problems(*_pastes(spark, sf_dir))


@query(r"""with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as x, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as i from documents),
m as (select doc_id, i, regexp_replace(array_to_string(string_split(regexp_replace(x, '[.!?…,]', '', 'g'), ' ')[1:1 + i % 4], ' '), '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g') as h from l),
k as (select doc_id, i, lower(regexp_extract(h, '[\p{L}\p{N}-]+')) as w, len(regexp_extract_all(h, '[\p{L}\p{N}-]+')) as n from m where h <> '' and length(h) < 90 and not regexp_matches(h, '[.!?…]$') and len(regexp_extract_all(h, '[\p{L}\p{N}_-]+')) <= 12),
s as (select doc_id, i, case when regexp_matches(w, '(ание|ение|ация|ость|ство)$') then 'nominal' when regexp_matches(w, '(ть|ing)$') then 'action' else 'name' end || ':' || case when n <= 2 then 'short' else 'long' end as k from k),
t as (select doc_id, k, count(*) as c, min(i) as first from s group by all),
d as (select doc_id, sum(c)::bigint as headings, arg_min(k, -c * 1000000 + first) as dominant, max(c) as c from t group by doc_id having sum(c) >= 3)
select doc_id, headings, dominant, c / headings as share, c / headings >= 0.8 as parallel from d""")
def shortened_heading_parallelism(spark, sf_dir):
    """How alike headings are built, in documents whose lines were cut to a few words by a rule, as the table has few headings of its own."""
    line = lambda x, i: F.array_join(F.slice(F.split(F.regexp_replace(x, "[.!?…,]", ""), " "), F.lit(1), i % 4 + 1), " ")
    cut = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line), "\n")
    return evidence.heading_schemas(documents(spark, sf_dir).withColumn("text", cut))
