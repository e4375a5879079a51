"""Registered queries: words, rules and bands that come as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.expressions import ansi, quoted
from colloquy.operators import bands as B
from colloquy.operators import division
from colloquy.operators import scoring as S
from colloquy.operators import words as W
from colloquy.plans import detections as D
from colloquy.plans import oracle as O
from colloquy.plans import rows as R
from colloquy.plans import tables
from colloquy.plans import dimensions as M
from colloquy.plans.catalog import _DISC_TYPES, _PROBE_ROWS, MODELS, ORACLES, WORDS, add, interviews, scored, scores_sql
from colloquy.sources.scratch import scratch

# a table of words as large as the benchmark has them, in twenty categories; all are counted in one pass over the answers
_WORD_TABLE = "select concat('list_', item_id % 20) as category, w as word from (select item_id, {} as w from {}) as words where length(w) >= 3 group by 1, 2"


def lexicon_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spark.sql(_WORD_TABLE.format("explode(split(text, ' '))", "{items}"), items=spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return W.category_hits(interviews(spark, sf_dir).select("interview_id", "t"), "t", tables.categories_of(words))


add("lexicon_automaton", lexicon_automaton, f"""with {O.SEGMENTS}, {O.TURNS}, {O.INTERVIEWS}, words as materialized ({_WORD_TABLE.format("unnest(string_split(text, ' '))", 'benchmark')}),
    found as (select interview_id, category, (strlen(t) - strlen(replace(t, word, ''))) // strlen(word) as n from base join words on contains(t, word))
    select interview_id, category, count(*) as words, sum(n)::bigint as hits from found group by all""")

#: The compiled rules of each scheme, which the table of rules has to agree with.
COMPILED = {
    "defect": R.STAR_DEFECTS, "interaction": R.INTERACTIONS, "finding": R.FINDINGS, "risk": R.HIRE_RISKS, "gap": R.GAPS, "pattern": R.TRAIT_PATTERNS,
    "conflict": R.CONFLICTS, "graph": R.GRAPH_CONFLICTS, "type": [(f"{c}@{i}", f"cast({d} as varchar(9))", w) for i, (c, d, w) in enumerate(S.BIGFIVE_TYPES)],
}


def rule_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detections of the library's rule table, by division."""
    detections = tables.detections_of(D.rule_table(spark))
    names = {c.feature for rules in detections.values() for r in rules for c in r.conditions}
    needs = " ".join(division.DERIVED.get(n, n) for n in sorted(names))
    return division.detect(scored(spark, sf_dir, needs), detections, D.CAPS)


_RULED = O.union([
    f"select interview_id, '{scheme}' as scheme, {i} as ord, {quoted(code)} as code, {ansi(detail)} as detail from scored where {ansi(where)}"
    for scheme, rules in COMPILED.items() for i, (code, detail, where) in enumerate(rules)
])
_ORDER = "case scheme when 'type' then -detail::int else 0 end, ord"
add("rule_division", rule_division, f"""{O.prelude(WORDS)}, ruled as ({_RULED}), once as (select * from ruled qualify row_number() over (partition by interview_id, scheme, code order by ord) = 1),
    placed as (select *, row_number() over (partition by interview_id, scheme order by {_ORDER}) as place from once)
    select interview_id, scheme, place, code, detail from placed left join (values {', '.join(f"('{k}', {n})" for k, n in D.CAPS.items())}) caps(name, most) on name = scheme where place <= coalesce(most, place)""")

# bands of the scores of three models from one table of cut points
_BANDED = [f"select *, {lo} as above, {hi} as upto from (select '{scheme}' as scheme, '{band}' as band)" for scheme, lo, hi, band in (
    (s, max([u for t, u, _ in M.BANDS if t == s and u is not None and (upto is None or u < upto)], default="-1e9"), 1e9 if upto is None else upto, band) for s, upto, band in M.BANDS
)]


def score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = ("bigfive", "star", "enneagram")
    row = scored(spark, sf_dir, " ".join(c for m in models for c in MODELS[m][1]))
    long = [S.score_rows(row, m, *MODELS[m]).withColumnRenamed("model", "scheme") for m in models]
    return B.banded(long[0].unionByName(long[1]).unionByName(long[2]), tables.bands_of(M.own_tables(spark)["bands"])).select("interview_id", "scheme", "dim", "score", "band")


add("score_bands", score_bands, f"""{O.prelude(WORDS)}, bands as ({O.union(_BANDED)}), long as ({O.union([scores_sql(m) for m in ("bigfive", "star", "enneagram")])})
    select interview_id, model as scheme, dim, score, band from long join bands on bands.scheme = model and score > above and score <= upto""")


def dimension_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five tables written and read back, and in how many interviews each of their rows counts."""
    path = scratch(spark, "dimensions")
    M.save(M.own_tables(spark, WORDS), path)
    found = M.load(spark, path)
    needs = {c.feature for rules in tables.detections_of(found["rules"]).values() for r in rules for c in r.conditions}
    text = " ".join(division.DERIVED.get(n, n) for n in sorted(needs)) + " disc_top " + " ".join(MODELS["bigfive"][1] + [f"defect_{k}" for k in R.PROBES])
    return M.used(interviews(spark, sf_dir), scored(spark, sf_dir, text), found)


_COUNT = "count(distinct interview_id) as interviews"
_WORD_ROWS = ", ".join(f"({quoted(k)}, {quoted(w)})" for k, ws in WORDS.items() for w in ws)
add("dimension_tables", dimension_tables, ORACLES["rule_division"].replace("select interview_id, scheme, place, code, detail from placed", ", detected as (select interview_id, scheme, code from placed", 1) + f"""),
    asked2 as ({_PROBE_ROWS}), big as ({scores_sql('bigfive')}), bands as ({O.union(_BANDED)})
    select 'rules' as kind, scheme, code, {_COUNT} from detected group by all
    union all select 'lexicon', '', category, {_COUNT} from base join (values {_WORD_ROWS}) l(category, word) on contains(w, word) group by all
    union all select 'bands', scheme, band, {_COUNT} from big join bands on bands.scheme = model and score > above and score <= upto group by all
    union all select 'probes', defect, question, {_COUNT} from (select * from asked2 qualify row_number() over (partition by interview_id, question order by case severity when 'high' then 0 when 'medium' then 1 else 2 end, defect, n) = 1) group by all
    union all select 'mappings', disc_top, v.type, {_COUNT} from scored join (values {_DISC_TYPES}) v(disc, type, weight) on v.disc = disc_top group by all""")
