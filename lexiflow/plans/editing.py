"""Queries on edits, documents, rewriting and selection over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiflow.functions import lexicon as L
from lexiflow.functions import text as T
from lexiflow.operators import documents as docs_
from lexiflow.operators import edits, elicit, layout, passes, references, report, rewriting, selection, spans
from lexiflow.plans import sql
from lexiflow.plans.registry import _TALL, _tall, documents, query
from lexiflow.session import spread

_TEXTS = "select doc_id, coalesce(text, '') as t from documents"


def _one(name: str, operator, *args, **kwargs) -> None:
    """Register a query that applies an operator to all documents."""

    def run(spark, sf_dir):
        return operator(documents(spark, sf_dir), *args, **kwargs)

    run.__name__, run.__doc__ = name, operator.__doc__
    query()(run)


for _name, _operator in {
    "edit_proposals": passes.edit_proposals, "edit_summary": passes.edit_summary, "edits_applied": passes.edited, "edit_manual_hints": passes.manual_hints,
    "document_blocks": docs_.document_blocks, "structured_documents": docs_.structured_documents, "structured_blocks": docs_.structured_blocks,
    "compliance_report": docs_.compliance_report, "paraphrase_documents": rewriting.paraphrased_documents, "paraphrase_variants": rewriting.document_variants,
    "replacement_options": rewriting.option_rows, "rewrite_documents": rewriting.rewritten_documents, "humanize_documents": rewriting.humanized_documents,
    "revise_documents": rewriting.revised_documents, "paragraph_questions": elicit.questions, "candidate_set": selection.candidate_rows,
    "improved_documents": selection.improved_documents, "polished_documents": selection.polished_documents, "sentence_reorders": selection.reorder_rows,
    "document_segments": layout.segment_rows, "section_readiness": layout.readiness, "inferred_sections": layout.inferred_sections,
    "arranged_documents": layout.arranged_documents, "work_pieces": layout.work_pieces,
}.items():
    _one(_name, _operator)
for _kind in passes.METHOD:
    _one(f"edit_pass_{_kind}", passes.edited, _kind)


@query(f"select doc_id, unnest(range(1, n_sentences + 1)) as pos from ({sql.score_sql()})")
def sentence_positions(spark, sf_dir):
    """Every sentence by its number."""
    return documents(spark, sf_dir).select("doc_id", F.posexplode(T.sentences(F.coalesce("text", F.lit("")))).alias("p", "s")).select("doc_id", (F.col("p") + 1).cast("long").alias("pos"))


@query(f"""select doc_id, pos, row_number() over (partition by doc_id order by pos) <= greatest(1, floor(count(*) over (partition by doc_id) * 0.15::double + 0.5)) as kept_for_zone
from (select doc_id, unnest(range(1, n_sentences + 1)) as pos from ({sql.score_sql()}))""")
def connective_budget_window(spark, sf_dir):
    """The first sentences of each document that the genre lets keep their links."""
    return edits.within_budget(sentence_positions(spark, sf_dir), passes.DISCOURSE_MOST)


@query()
def edit_resolve(spark, sf_dir):
    """The edits that raw proposals come down to where they overlap."""

    def rows(i, t):
        d = passes.Draft(t)
        return [(i, e.start, e.end, passes.PRIORITY[e.kind], e.after) for run in (passes.reduction, passes.connectives, passes.denominal) for e in run(d)]

    raw = passes._mapped(documents(spark, sf_dir), "doc_id long, start long, end long, priority int, after string", rows)
    return edits.resolve(raw)


@query()
def edit_apply_rows(spark, sf_dir):
    """Proposals as a table, put into their documents again."""
    d = documents(spark, sf_dir)
    return passes.apply_rows(d, passes.edit_proposals(d))


_STANDING = ", ".join(f"({m}, {sql.q(h)})" for m, h in passes.STANDING_HINTS)
_LOW = ", ".join(f"({m}, {sql.q(i)}, {sql.q(h)})" for m, i, h in passes.LOW_HINTS)


@query(f"""with t as ({_TALL}), l(method, metric_id, hint) as (values {_LOW}), s(method, hint) as (values {_STANDING})
select doc_id, method, hint from t join l using (metric_id) where status = 'low' union all select doc_id, method, hint from (select distinct doc_id from t), s""")
def author_hints(spark, sf_dir):
    return passes.author_hints(_tall(spark, sf_dir).withColumnRenamed("metric_id", "metric"))


@query(f"""with t as ({_TALL}), z(language, metric_id, overshoot) as (values {", ".join(f"({sql.q(g)}, {sql.q(m)}, {z[2]})" for g, t in L.ZONES.items() for m, z in t.items())})
select doc_id, metric_id, value, overshoot::double as overshoot from t join z using (language, metric_id) where value >= overshoot""")
def overshoot_warnings(spark, sf_dir):
    return report.overshoot_warnings(report.metrics_wide(documents(spark, sf_dir)))


@query(f"""with c as (select language, metric_id, count(*) as texts from ({_TALL}) where value is not null group by all)
select language, metric_id, texts, true as applied, texts >= 100 as trustworthy from c""")
def calibration_trust(spark, sf_dir):
    """Which zones the corpus could set anew."""
    return report.calibration_status(report.calibration(report.metrics_wide(documents(spark, sf_dir)))).select("language", "metric_id", "texts", "applied", "trustworthy")


def _genre(genre: str) -> None:
    def run(spark, sf_dir):
        return report.metrics_tall(report.metrics_wide(documents(spark, sf_dir)), genre)

    run.__name__, run.__doc__ = f"metrics_of_{genre.replace('-', '_')}", "The report by the zones of another genre."
    query(sql.tall_sql(genre))(run)


for _name in L.GENRE_ZONES:
    _genre(_name)

_PARTS = " union all ".join(f"select doc_id, {sql.q(p.title)} as part from d where not regexp_matches(t, {sql.q(p.found)})" for p in docs_.PARTS)


@query(f"with d as ({_TEXTS}) {_PARTS}")
def missing_parts(spark, sf_dir):
    return docs_.missing_parts(documents(spark, sf_dir))


@query(f"select doc_id, kind, method, asks from documents, (values {', '.join(f'({sql.q(k)}, {m}, {sql.q(a)})' for k, m, a in elicit.CHECKLIST)}) v(kind, method, asks)")
def author_checklist(spark, sf_dir):
    return elicit.checklist(documents(spark, sf_dir))


@query(r"""with w as (select doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '\p{L}[\p{L}\p{N}-]{3,}'), lambda x: lower(x)) as ws from documents),
f as (select doc_id, ws[i] as form, 2 * i as place from (select doc_id, ws, unnest(range(1, len(ws) + 1)) as i from w)
  union all select doc_id, ws[i] || ' ' || ws[i + 1], 2 * i + 1 from (select doc_id, ws, unnest(range(1, len(ws))) as i from w)),
g as (select doc_id, replace(replace(form, '-', ''), ' ', '') as key, form, count(*) as n, min(place) as place from f where length(replace(replace(form, '-', ''), ' ', '')) >= 6 group by all),
k as (select doc_id, key, list(form order by n desc, place) as forms, sum(n)::bigint as n, min(place) as place from g group by doc_id, key having count(*) > 1),
r as (select *, row_number() over (partition by doc_id order by n desc, place) as rank from k)
select doc_id, rank::integer as rank, key, forms, n from r where rank <= 8""")
def terminology_drift(spark, sf_dir):
    return elicit.terminology(documents(spark, sf_dir))


@query(r"""with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as x, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos from documents),
s as (select doc_id, pos, regexp_replace(x, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g') as item from l)
select doc_id, pos::integer as pos, item from s where regexp_matches(item, '^(?:[-*•▪◦]|[0-9]+[.)])[\s\x{00A0}]')""")
def list_items(spark, sf_dir):
    """The lines of a document that are items of a list."""
    return list_items_of(documents(spark, sf_dir))


def list_items_of(docs):
    """(doc_id, pos, item): the lines of ``docs`` that start with a mark of a list."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), T.strip)
    return docs.select("doc_id", F.posexplode(lines).alias("pos", "item")).where(F.col("item").rlike("(?U)^(?:[-*•▪◦]|[0-9]+[.)])\\s"))


@query()
def grammar_edits(spark, sf_dir):
    """Closed phrases in each document, with what stands for them."""
    return passes._mapped(documents(spark, sf_dir), "doc_id long, start long, end long, replacement string", lambda i, t: [(i, *e) for e in rewriting.grammar_edits(t)])


@query()
def step_integrity(spark, sf_dir):
    """What each document's rewriting breaks, if anything."""

    def rows(i, t):
        return [(i, ",".join(rewriting.broken(t, rewriting.rewrite(t)[0])))]

    return passes._mapped(documents(spark, sf_dir), "doc_id long, broken string", rows)


@query()
def candidate_select(spark, sf_dir):
    """Each document's candidate with the lowest score; the source wins ties."""
    return edits.select_best(selection.candidate_scores(documents(spark, sf_dir)))


@query()
def sentence_spans(spark, sf_dir):
    return selection.sentence_spans(documents(spark, sf_dir))


@query()
def reference_context(spark, sf_dir):
    """What stands around each literal reference."""
    d = documents(spark, sf_dir)
    return selection.context(references.reference_ranges(d), d)


@query()
def frozen_edits(spark, sf_dir):
    """Intensifiers of each document that no literal reference holds."""
    d = documents(spark, sf_dir)
    raw = passes._mapped(d, "doc_id long, start long, end long", lambda i, t: [(i, e.start, e.end) for e in passes.reduction(passes.Draft(t))])
    return spans.outside_ranges(raw, references.reference_ranges(d).select("doc_id", "start", "end"))


@query()
def page_blocks(spark, sf_dir):
    """The blocks of every web page."""
    from lexiflow.sources.pasted import page_blocks as blocks

    return blocks(spread(spark.read.parquet(f"{sf_dir}/pages.parquet"), heavy=True))


@query()
def document_packages(spark, sf_dir):
    """Every document as a Word package, read again: its blocks by kind."""
    from lexiflow.sources.packages import docx_blocks, docx_files

    files = docx_files(docs_.structured_blocks(documents(spark, sf_dir)).select("doc_id", "pos", "type", "level", F.when(F.col("type") == "paragraph", F.col("text")).otherwise(F.coalesce(F.nullif("text", F.lit("")), "title")).alias("text")))
    return docx_blocks(files.selectExpr("cast(doc_id as string) as path", "content")).groupBy("path", "type").agg(F.count("*").alias("n"))
