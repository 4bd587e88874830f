"""Queries of rollups, pairs, judge scores, failures and concentration."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyscale.functions.lexicon import DIMENSIONS, JUDGE_METRICS, METRICS, SECONDARY, SECONDARY_NOTE, STORY_DIMENSIONS
from storyscale.functions.numeric import exact_round, rounded_means
from storyscale.functions.text import truncate
from storyscale.operators import errors, judge, objective, pairs, rollup
from storyscale.plans import judged as judged_plan
from storyscale.plans import oracle as O
from storyscale.plans.query import query
from storyscale.sources.shared import stored, work_dir
from storyscale.sources.tables import KEYS, quoted, recorded_judge, stories, values

_KEYS = ", ".join(KEYS)
_q = O.text


def scored(spark, sf_dir) -> DataFrame:
    return objective.scored(stories(spark, sf_dir))


def judged(spark, sf_dir) -> DataFrame:
    """Scored rows with the recorded judge scores, and a group's consistency on its judged rows.

    Rows are scored once and stored without their texts, and stored again with all scores: what stands
    on them scans them alone.
    """
    rows = stored(scored(spark, sf_dir).drop("story", "prompt"), work_dir(spark, "scored"))
    return stored(with_consistency(rows.join(recorded_judge(spark, sf_dir), "row_ord", "left")), work_dir(spark, "judged"))


def with_consistency(df: DataFrame) -> DataFrame:
    """One consistency score for each (model, prompt) over its judged rows, put back on these rows."""
    was = F.col("spec_adherence_score").isNotNull()
    rate = F.when(was, F.col("decodability_compliance"))
    spread = exact_round(F.max(rate) - F.min(rate))
    groups = df.groupBy("model", "prompt_id").agg(F.when(spread <= 0.2, 2).when(spread <= 0.5, 1).otherwise(0).alias("__consistency"))
    return df.join(groups, ["model", "prompt_id"]).withColumn("consistency_score", F.when(was, F.col("__consistency"))).drop("__consistency")


_CONSISTENT = f"""grouped AS (SELECT model, prompt_id, CASE WHEN spread <= 0.2::double THEN 2 WHEN spread <= 0.5::double THEN 1 ELSE 0 END AS consistency FROM (SELECT model, prompt_id, {O.rounded('hi - lo')} AS spread FROM
  (SELECT model, prompt_id, max(decodability_compliance) FILTER (spec_adherence_score IS NOT NULL) AS hi, min(decodability_compliance) FILTER (spec_adherence_score IS NOT NULL) AS lo FROM objective LEFT JOIN judge USING (row_ord) GROUP BY ALL))),
judged AS MATERIALIZED (SELECT o.*, j.* EXCLUDE (row_ord), CASE WHEN j.row_ord IS NOT NULL THEN g.consistency END AS consistency_score FROM objective o LEFT JOIN judge j USING (row_ord) JOIN grouped g USING (model, prompt_id))"""
TO_JUDGED = (*O.TO_JUDGED, _CONSISTENT)


def _means(metrics, digits: int = 4) -> str:
    return ", ".join(f'{O.rounded(O.mean(c), d)} AS "{name}"' for name, c, d in metrics)


_TITLED = _means([(t, k, 4) for k, t in (METRICS | SECONDARY).items()])
_JUDGE_TITLED = _means([(t, k, 4) for k, t in JUDGE_METRICS.items()])


@query(O.query(f"SELECT model, count(*) AS n, {_means(rollup.SHORT)} FROM objective GROUP BY model", *O.TO_OBJECTIVE))
def summary_by_model(spark, sf_dir):
    """Short means of each model."""
    return rollup.summarize(scored(spark, sf_dir), "model")


@query(O.query(f"SELECT model, prompt_id, arg_min(target_phonics, row_ord) AS target_phonics, count(*) AS n, {_means(rollup.SHORT)} FROM objective GROUP BY model, prompt_id", *O.TO_OBJECTIVE))
def summary_by_model_prompt(spark, sf_dir):
    """Short means of each model and prompt."""
    return rollup.summarize(scored(spark, sf_dir), "model", "prompt_id")


@query(O.query(f"SELECT model, count(*) AS n, {_TITLED} FROM objective GROUP BY model", *O.TO_OBJECTIVE))
def objective_summary_by_model(spark, sf_dir):
    """Titled objective means of each model."""
    return rollup.objective_summary(scored(spark, sf_dir), "model")


@query(O.query(f"SELECT model, prompt_id, arg_min(target_phonics, row_ord) AS target_phonics, count(*) AS n, {_TITLED} FROM objective GROUP BY model, prompt_id", *O.TO_OBJECTIVE))
def objective_summary_by_prompt(spark, sf_dir):
    """Titled objective means of each model and prompt."""
    return rollup.objective_summary(scored(spark, sf_dir), "model", "prompt_id")


@query(O.query(f"SELECT model, prompt_id, prompt_id IS NULL AS of_model, CASE WHEN prompt_id IS NOT NULL THEN arg_min(target_phonics, row_ord) END AS target_phonics, count(*) AS n, {_TITLED} FROM objective GROUP BY GROUPING SETS ((model), (model, prompt_id))", *O.TO_OBJECTIVE))
def objective_summaries(spark, sf_dir):
    """Both of these summaries from one scan, by grouping sets."""
    return rollup.objective_summaries(scored(spark, sf_dir))


@query(O.query(f"SELECT model, count(*) AS n, {_JUDGE_TITLED} FROM judged WHERE spec_adherence_score IS NOT NULL GROUP BY model", *TO_JUDGED))
def subjective_summary(spark, sf_dir):
    """Titled judge means of each model, of judged rows."""
    return rollup.subjective_summary(judged(spark, sf_dir), "model")


@query(O.query(f"SELECT model, prompt_id, count(*) AS n, {_JUDGE_TITLED} FROM judged WHERE spec_adherence_score IS NOT NULL GROUP BY model, prompt_id", *TO_JUDGED))
def subjective_by_prompt(spark, sf_dir):
    """Titled judge means of each model and prompt, of judged rows."""
    return rollup.subjective_summary(judged(spark, sf_dir), "model", "prompt_id")


_DIM_MEANS = _means([(f"mean_{d}", f"{d}_score", 4) for d in DIMENSIONS])


@query(O.query(f"SELECT model, prompt_id, count(*) AS n, {_DIM_MEANS} FROM judged WHERE spec_adherence_score IS NOT NULL GROUP BY model, prompt_id", *TO_JUDGED))
def dimension_summary(spark, sf_dir):
    """Means of the five score dimensions, by any keys."""
    return rollup.dimension_means(judged(spark, sf_dir).where("spec_adherence_score IS NOT NULL"), DIMENSIONS, "model", "prompt_id")


def _long(metrics) -> str:
    def one(k, t, f, note):
        value = f"coalesce({k}, 0)" if f == "judge" else k
        mean = lambda m: O.rounded(O.mean(f"CASE WHEN model = '{m}' THEN {value} END"))
        return f"SELECT {_q(t)} AS metric, {_q(k)} AS metric_key, {_q(f)} AS metric_family, {mean('base')} AS base_mean, {mean('tuned')} AS tuned_mean, {_q(note)} AS note, count(*) FILTER (model = 'base') AS n_base, count(*) FILTER (model = 'tuned') AS n_tuned FROM {{}}"

    return " UNION ALL ".join(one(*x) for x in metrics)


_OBJECTIVE_ONLY = [(k, t, "objective", "") for k, t in METRICS.items()]
_ALL = [*_OBJECTIVE_ONLY, *[(k, t, "objective_secondary", SECONDARY_NOTE) for k, t in SECONDARY.items()], *[(k, t, "judge", "") for k, t in JUDGE_METRICS.items()]]
_DELTA = f"SELECT *, CASE WHEN n_base > 0 AND n_tuned > 0 THEN {O.rounded('tuned_mean - base_mean')} END AS tuned_minus_base FROM ("


@query(O.query(_DELTA + _long(_ALL).replace("{}", "judged") + ")", *TO_JUDGED))
def evaluation_summary(spark, sf_dir):
    """A row for each metric with both models' means and their difference."""
    return rollup.evaluation_summary(judged(spark, sf_dir))


@query(O.query(_DELTA + _long(_OBJECTIVE_ONLY).replace("{}", "objective") + ")", *O.TO_OBJECTIVE))
def evaluation_summary_objective(spark, sf_dir):
    """The same without judge scores."""
    return rollup.evaluation_summary(scored(spark, sf_dir), with_judge=False)


_LAST = f"lasts AS MATERIALIZED (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY model, {_KEYS} ORDER BY row_ord DESC) AS r FROM objective) WHERE r = 1)"
_PAIR_COLS = ", ".join(
    f"b.{m} AS base_{m}, t.{m} AS tuned_{m}, {O.rounded(f't.{m} - b.{m}')} AS {d}"
    for m, d in {"decodability_compliance": "compliance_delta", "weighted_above_level_rate": "weighted_rate_delta", "target_satisfaction_rate": "satisfaction_delta"}.items()
)
_PAIRED = f"paired AS MATERIALIZED (SELECT {', '.join(f'b.{k}' for k in KEYS)}, b.target_phonics, {_PAIR_COLS}, b.word_count AS base_word_count, t.word_count AS tuned_word_count FROM lasts b JOIN lasts t USING ({_KEYS}) WHERE b.model = 'base' AND t.model = 'tuned')"
_TO_PAIRED = (*O.TO_OBJECTIVE, _LAST, _PAIRED)


@query(O.query("SELECT * FROM paired", *_TO_PAIRED))
def paired_comparison(spark, sf_dir):
    """Both sides of each complete pair and their differences."""
    return pairs.paired_comparison(scored(spark, sf_dir))


@query(O.query(f"SELECT count(*) AS unmatched FROM (SELECT {_KEYS} FROM stories GROUP BY ALL HAVING count(DISTINCT model) < 2)", O.STORIES))
def paired_unmatched(spark, sf_dir):
    """How many keys lack a side."""
    return pairs.unmatched(stories(spark, sf_dir))


@query(O.query("SELECT count(*) AS n, " + ", ".join(f"{O.rounded(O.mean(d))} AS mean_{d}" for d in ("compliance_delta", "weighted_rate_delta", "satisfaction_delta")) + " FROM paired", *_TO_PAIRED))
def paired_means(spark, sf_dir):
    """Mean differences over all pairs."""
    return pairs.means(pairs.paired_comparison(scored(spark, sf_dir)))


@query(O.query(f"SELECT {_KEYS}, max(row_ord) FILTER (model = 'base') AS base_row, max(row_ord) FILTER (model = 'tuned') AS tuned_row, count(*) AS n_rows FROM stories GROUP BY ALL", O.STORIES))
def paired_last_wins(spark, sf_dir):
    """The row of each side that a repeated key keeps."""
    df = stories(spark, sf_dir)
    counts = df.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_rows"))
    return pairs.pair_rows(df, ["row_ord"]).select(*KEYS, F.col("base.row_ord").alias("base_row"), F.col("tuned.row_ord").alias("tuned_row")).join(counts, list(KEYS))


def _only(a: str, b: str) -> str:
    return f"SELECT *, 'only_{a}' AS side FROM (SELECT {_KEYS} FROM stories WHERE model = '{a}' EXCEPT SELECT {_KEYS} FROM stories WHERE model = '{b}')"


@query(O.query(f"{_only('base', 'tuned')} UNION ALL {_only('tuned', 'base')}", O.STORIES))
def key_gate(spark, sf_dir):
    """Keys of one model that the other lacks."""
    return pairs.key_gate(stories(spark, sf_dir))


# -- judge ----------------------------------------------------------------------------------------

_OK = '{"spec_adherence": {"score": 2, "justification": "Good. More text."}, "robustness": {"score": 1, "justification": "Fine"}, "task_quality": {"score": 0, "justification": " Weak! "}}'
PAYLOADS = [(str(i), p) for i, p in enumerate((
    _OK, "```json\n" + _OK + "\n```", "Here it is: " + _OK + " Done.", _OK.replace('"score": 1,', '"score": 1.0,'), _OK.replace('"score": 1,', '"score": 1.5,'), _OK.replace('"score": 1,', '"score": 3,'), _OK.replace('"score": 1,', '"score": -1,'),
    _OK.replace('"score": 1,', '"score": true,'), _OK.replace('"score": 1,', '"score": "1",'), _OK.replace('"robustness"', '"robust"'), _OK.replace('"score": 2, ', ""), _OK.replace('{"score": 1, "justification": "Fine"}', "7"), _OK.replace('"Fine"', '"  "'),
    "", "   ", "[1,2]", "[" + _OK + "]", "{not json}", "no braces at all", _OK.replace('"Fine"', "12"), _OK.replace('"score": 2,', '"score": 2e0,'),
))] + [("null", None)]

_FENCE = r"regexp_extract(t, '(?s)```(?:json)?\s*(\{.*?\})\s*```', 1)"
_OBJECT = f"CASE WHEN {_FENCE} <> '' THEN {_FENCE} WHEN position('{{' IN t) > 0 AND position('}}' IN t) > 0 AND length(t) - position('}}' IN reverse(t)) + 1 > position('{{' IN t) THEN substr(t, position('{{' IN t), length(t) - position('}}' IN reverse(t)) + 1 - position('{{' IN t) + 1) END"
_NUMERIC = "('BIGINT', 'UBIGINT', 'DOUBLE')"


def _reject(dims=STORY_DIMENSIONS) -> str:
    out = "CASE WHEN t = '' THEN 'empty response' WHEN obj IS NULL THEN 'no object' WHEN NOT json_valid(obj) THEN 'invalid JSON'"
    for d in dims:
        kind = lambda p: f"json_type(obj, '$.{d}{p}')"
        value = lambda p: f"json_extract_string(obj, '$.{d}{p}')"
        out += f" WHEN {kind('')} IS NULL THEN '{d}: missing' WHEN {kind('')} <> 'OBJECT' THEN '{d}: not an object' WHEN {kind('.score')} IS NULL OR {kind('.justification')} IS NULL THEN '{d}: missing field'"
        out += f" WHEN {kind('.score')} NOT IN {_NUMERIC} THEN '{d}: score not numeric' WHEN CAST({value('.score')} AS DOUBLE) NOT IN (0, 1, 2) THEN '{d}: score out of range' WHEN {O.strip(value('.justification'))} = '' THEN '{d}: blank justification'"
    return out + " END"


def _parsed(payloads, dims=STORY_DIMENSIONS) -> str:
    return f"parsed AS (SELECT *, {_reject(dims)} AS error FROM (SELECT id, t, {_OBJECT} AS obj FROM (SELECT id, {O.strip('coalesce(payload, chr(32))')} AS t FROM (VALUES {quoted(payloads)}) v(id, payload))))"


_PARSED = _parsed(PAYLOADS)
_SPLIT = r"regexp_replace({}, '([.!?])\s+.*$', '\1')"


def _accepted(d: str) -> tuple[str, str]:
    """Score and first sentence of a dimension of an accepted payload."""
    said = _SPLIT.format(O.strip(f"json_extract_string(obj, '$.{d}.justification')"))
    return f"CAST(CAST(json_extract_string(obj, '$.{d}.score') AS DOUBLE) AS INT)", said


def _parse_sql(dims) -> str:
    return "SELECT id, " + ", ".join(f"CASE WHEN error IS NULL THEN {v} END AS {d}_{k}" for d in dims for k, v in zip(("score", "justification"), _accepted(d))) + " FROM parsed"


@query(O.query(_parse_sql(STORY_DIMENSIONS), _PARSED))
def judge_parse(spark, sf_dir):
    """Scores and first sentences of judge payloads, null where one is rejected."""
    df = judge.validate(values(spark, "id payload", PAYLOADS), "payload", STORY_DIMENSIONS)
    return df.select("id", *[f"{d}_{k}" for d in STORY_DIMENSIONS for k in ("score", "justification")])


@query(O.query("SELECT id, error FROM parsed WHERE error IS NOT NULL", _PARSED))
def judge_reject_reasons(spark, sf_dir):
    """Why payloads are rejected."""
    return judge.present(judge.validate(values(spark, "id payload", PAYLOADS), "payload", STORY_DIMENSIONS).select("id", "error"), "error")


#: Payloads of the five dimensions and of consistency: good ones, and each dimension missing, out of range, blank or of another kind.
FIVE = [("good", json.dumps({d: {"score": i % 3, "justification": f"{d} told. More."} for i, d in enumerate(DIMENSIONS)}))]
FIVE += [(f"{d} {n}", json.dumps({k: v for k, v in (json.loads(FIVE[0][1]) | {d: bad}).items() if v is not None})) for d in DIMENSIONS for n, bad in (("missing", None), ("high", {"score": 3, "justification": "x"}), ("true", {"score": True, "justification": "x"}), ("blank", {"score": 1, "justification": " "}), ("list", [1]))]
ONE = [("good", '{"consistency": {"score": 2, "justification": "Same level. All three."}}'), ("half", '{"consistency": {"score": 0.5, "justification": "x"}}'), ("other", '{"robustness": {"score": 1, "justification": "x"}}'), ("told", 'As JSON: {"consistency": {"score": 0, "justification": "Swings!"}}'), ("null", None)]


@query(O.query(_parse_sql(DIMENSIONS).replace(" FROM parsed", ", error FROM parsed"), _parsed(FIVE, DIMENSIONS)))
def judge_parse_five(spark, sf_dir):
    """Payloads of the five dimensions."""
    df = judge.validate(values(spark, "id payload", FIVE), "payload", DIMENSIONS)
    return df.select("id", *[f"{d}_{k}" for d in DIMENSIONS for k in ("score", "justification")], "error")


@query(O.query(_parse_sql(judge.CONSISTENCY).replace(" FROM parsed", ", error FROM parsed"), _parsed(ONE, judge.CONSISTENCY)))
def judge_parse_consistency(spark, sf_dir):
    """Payloads of a group's consistency."""
    return judge.validate(values(spark, "id payload", ONE), "payload", judge.CONSISTENCY).select("id", "consistency_score", "consistency_justification", "error")


_JSON = "{" + ", ".join(f"'{d}': {{'score': {v}, 'justification': {t}}}" for d in STORY_DIMENSIONS for v, t in (_accepted(d),)) + "}"


@query(O.query(f"SELECT id, CAST(to_json({_JSON}) AS VARCHAR) AS raw_json FROM parsed WHERE error IS NULL", _PARSED))
def judge_canonical_json(spark, sf_dir):
    """Accepted payloads written anew."""
    return judge.present(judge.validate(values(spark, "id payload", PAYLOADS), "payload", STORY_DIMENSIONS).select("id", "raw_json"), "raw_json")


_TEXT = judge.story_parts()


@query(O.query(f"SELECT row_ord, {_q(_TEXT[0])} || target_phonics || {_q(_TEXT[1])} || 'Write a decodable story: ' || target_phonics || {_q(_TEXT[2])} || story || {_q(_TEXT[3])} AS content FROM stories", O.STORIES))
def judge_messages(spark, sf_dir):
    """Chat messages for each story, without its model."""
    df = stories(spark, sf_dir)
    return df.select("row_ord", judge.story_messages(F.col("target_phonics"), F.col("prompt"), F.col("story"))[1]["content"].alias("content"))


_TOLD = f"length({_q(_TEXT[0])} || target_phonics || {_q(_TEXT[1])} || 'Write a decodable story: ' || target_phonics || {_q(_TEXT[2])} || story || {_q(_TEXT[3])})"
_PARTS = f"string_agg('[generation_id=' || generation_id || ']' || chr(10) || story, {_q(judge.GAP)} ORDER BY generation_id, row_ord)"
_GROUP = f"'Target phonics: ' || arg_min(target_phonics, row_ord) || chr(10) || chr(10) || 'Generation prompt (context only):' || chr(10) || 'Write a decodable story: ' || arg_min(target_phonics, row_ord) || {_q(judge.TOLD)} || {_PARTS} || {_q(judge.consistency_asked())}"


@query(O.query(f"SELECT model, prompt_id, CAST(length(content) AS INTEGER) AS chars, md5(content) AS content_md5 FROM (SELECT model, prompt_id, {_GROUP} AS content FROM stories GROUP BY model, prompt_id)", O.STORIES))
def consistency_messages(spark, sf_dir):
    """Length and digest of the message on all generations of each model and prompt."""
    content = F.col("messages")[1]["content"]
    return judge.consistency_messages(stories(spark, sf_dir)).select("model", "prompt_id", F.length(content).alias("chars"), F.md5(content.cast("binary")).alias("content_md5"))


@query(O.query(f"SELECT model, prompt_id, count(*) AS n, CAST(length({_PARTS}) AS BIGINT) AS chars, CAST(strlen({_PARTS}) AS BIGINT) AS bytes FROM stories GROUP BY model, prompt_id", O.STORIES))
def group_digests(spark, sf_dir):
    """How many generations each model and prompt have, and how long they are joined in order, however many tasks a group takes."""
    return judge.group_digests(stories(spark, sf_dir)).drop("crc32")


def by_length(messages: list[dict]) -> str:
    """A judge whose scores follow from the message's length, so that a whole judged run can be held against SQL."""
    content = messages[1]["content"]
    score = (len(content) if isinstance(content, str) else sum(map(len, content))) % 3
    return json.dumps({d: {"score": score, "justification": "By length."} for d in (*STORY_DIMENSIONS, *judge.CONSISTENCY)})


by_length.reads_parts = True


@query(O.query(
    f"""SELECT s.row_ord, {', '.join(f'f.score AS {d}_score' for d in STORY_DIMENSIONS)}, g.score AS consistency_score FROM stories s
    JOIN (SELECT model, prompt_id, generation_id, CAST(arg_min({_TOLD}, row_ord) % 3 AS INTEGER) AS score FROM stories GROUP BY ALL) f ON f.model = s.model AND f.prompt_id = s.prompt_id AND f.generation_id = s.generation_id
    JOIN (SELECT model, prompt_id, CAST(length({_GROUP}) % 3 AS INTEGER) AS score FROM stories GROUP BY model, prompt_id) g ON g.model = s.model AND g.prompt_id = s.prompt_id""", O.STORIES))  # fmt: skip
def judged_run(spark, sf_dir):
    """Scores of all stories and groups by a judged run from messages to log, validation and merge."""
    tasks = spark.sparkContext.defaultParallelism
    out = judged_plan.judged_rows(spark, stories(spark, sf_dir), by_length, work_dir(spark, "judged-log"), pause=0, tasks=tasks)
    return out.select("row_ord", *[f"{d}_score" for d in (*STORY_DIMENSIONS, *judge.CONSISTENCY)])


@query(O.query("SELECT s.row_ord, CASE WHEN l.doc_id IS NULL THEN 'to_judge' ELSE 'carried' END AS part FROM stories s LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON s.row_ord = l.doc_id", O.STORIES))
def judge_resume_split(spark, sf_dir):
    """Rows that are judged already and rows that are still to judge."""
    carried, todo = judge.resume_split(stories(spark, sf_dir).select("row_ord"), recorded_judge(spark, sf_dir), ("row_ord",))
    return carried.withColumn("part", F.lit("carried")).unionByName(todo.withColumn("part", F.lit("to_judge")))


@query(O.query("SELECT j.row_ord, j.overall_spec_adherence_score, o.model, o.prompt_id, o.decodability_compliance FROM judge j LEFT JOIN objective o USING (row_ord)", *O.TO_JUDGED))
def judge_merge_final(spark, sf_dir):
    """Judge rows with their objective columns."""
    out = judge.merge_final(scored(spark, sf_dir), recorded_judge(spark, sf_dir), ("row_ord",))
    return out.select("row_ord", "overall_spec_adherence_score", "model", "prompt_id", "decodability_compliance")


@query(O.query("SELECT row_ord, model, prompt_id, consistency_score FROM judged", *TO_JUDGED))
def consistency_groups(spark, sf_dir):
    """The consistency score of each group on its judged rows."""
    return judged(spark, sf_dir).select("row_ord", "model", "prompt_id", "consistency_score")


_COMBINED = ["decodability_compliance", "target_satisfaction_rate"]


@query(O.query(f"SELECT coalesce(o.model, s.model) AS model, o.n AS n_objective, s.n AS n_judged, {', '.join('o.mean_' + c for c in _COMBINED)}, s.mean_overall_spec_adherence FROM (SELECT model, count(*) AS n, {_means([(f'mean_{c}', c, 4) for c in _COMBINED])} FROM judged GROUP BY model) o FULL JOIN (SELECT model, count(*) AS n, {_means([('mean_overall_spec_adherence', 'overall_spec_adherence_score', 4)])} FROM judged WHERE spec_adherence_score IS NOT NULL GROUP BY model) s ON o.model = s.model", *TO_JUDGED))
def combined_summary(spark, sf_dir):
    """Objective and judge means of each model side by side."""
    df = judged(spark, sf_dir)
    o = rollup.summarize(df, "model").select("model", F.col("n").alias("n_objective"), *[f"mean_{c}" for c in _COMBINED])
    s = rollup.dimension_means(df.where("spec_adherence_score IS NOT NULL"), ("overall_spec_adherence",), "model").withColumnRenamed("n", "n_judged")
    return o.join(s, "model", "full_outer")


@query(O.query(" UNION ALL ".join(
    f"SELECT '{n}' AS metric, b, t, CASE WHEN {s} * (t - b) > {m}::double THEN 'improved' WHEN {s} * (t - b) < -{m}::double THEN 'regressed' ELSE 'unchanged' END AS verdict FROM (SELECT {O.rounded(O.mean(f'''CASE WHEN model = 'base' THEN {c} END'''))} AS b, {O.rounded(O.mean(f'''CASE WHEN model = 'tuned' THEN {c} END'''))} AS t FROM judged WHERE {'spec_adherence_score IS NOT NULL' if m == 0.05 else 'TRUE'})"
    for n, c, s, m in rollup.FLAGS), *TO_JUDGED))
def interpretation_flags(spark, sf_dir):
    """Which means the tuned model improved or worsened beyond a margin."""
    return rollup.interpretation(judged(spark, sf_dir)).select("metric", "b", "t", "verdict")


@query(O.query("SELECT row_ord, CAST(" + " + ".join(f"{d}_score" for d in DIMENSIONS) + " AS INT) AS subjective_total FROM judge", O.JUDGED))
def subjective_total(spark, sf_dir):
    """Sum of the five scores of each judged row."""
    return recorded_judge(spark, sf_dir).select("row_ord", judge.subjective_total().alias("subjective_total"))


_HARD = _means([(f"mean_{d}", f"{d}_score", 4) for d in ("overall_spec_adherence", "decodability_adherence", "target_phonics_pattern_emphasis", "narrative_completeness")])


@query(O.query(f"SELECT * FROM (SELECT prompt_id, {_HARD} FROM judged WHERE model = 'tuned' AND spec_adherence_score IS NOT NULL GROUP BY prompt_id) ORDER BY mean_overall_spec_adherence, mean_decodability_adherence, mean_target_phonics_pattern_emphasis, mean_narrative_completeness, prompt_id LIMIT 3", *TO_JUDGED))
def judge_hardest_prompts(spark, sf_dir):
    """The three prompts that the judge finds hardest for the tuned model."""
    return rollup.hardest_prompts(judged(spark, sf_dir))


# -- failures -------------------------------------------------------------------------------------

_SLICE_ROWS = " UNION ALL ".join(f"SELECT '{n}' AS failure_type, * FROM judged WHERE model = 'tuned' AND {c.replace('D', '::double')}" for n, c in errors.SLICES)
_SLICE_COLS = "failure_type, rank, n_tuned_flagged, pct_tuned_flagged, row_ord, prompt_id, generation_id, seed, above_level_rate, sentence_count, incomplete_output, spec_adherence_score, robustness_score, task_quality_score, consistency_score"


@query(O.query(f"SELECT {_SLICE_COLS} FROM (SELECT *, {O.rounded('n_tuned_flagged::double / greatest(total, 1)')} AS pct_tuned_flagged FROM (SELECT *, CAST(row_number() OVER (PARTITION BY failure_type ORDER BY coalesce(spec_adherence_score, 0), coalesce(task_quality_score, 0), coalesce(robustness_score, 0), above_level_rate DESC, row_ord) AS INT) AS rank, count(*) OVER (PARTITION BY failure_type) AS n_tuned_flagged, (SELECT count(*) FROM judged WHERE model = 'tuned') AS total FROM ({_SLICE_ROWS}))) WHERE rank <= 8", *TO_JUDGED))
def error_slices(spark, sf_dir):
    """The worst tuned rows of each failure type."""
    return errors.error_slices(judged(spark, sf_dir)).select(*_SLICE_COLS.split(", "))


_S0 = ", ".join(f"coalesce({s}, 0) AS {s}" for s in errors.SCORES)
_F = ["row_ord", "target_phonics", "decodability_compliance", "above_level_rate", "weighted_above_level_rate", "target_satisfaction_rate", "word_count", *errors.SCORES]
_EXAMINED = f"""final AS MATERIALIZED (SELECT * EXCLUDE (r) FROM (SELECT model, {_KEYS}, story, {', '.join(f for f in _F if f not in errors.SCORES)}, {_S0}, row_number() OVER (PARTITION BY model, {_KEYS} ORDER BY row_ord DESC) AS r FROM judged) WHERE r = 1),
examined AS MATERIALIZED (SELECT {', '.join('b.' + k for k in KEYS)}, {', '.join(f'b.{f} AS b_{f}, t.{f} AS t_{f}' for f in [*_F, 'story'])}, {O.rounded('t.decodability_compliance - b.decodability_compliance')} AS compliance_delta FROM final b JOIN final t USING ({_KEYS}) WHERE b.model = 'base' AND t.model = 'tuned')"""


def _cause_sql() -> str:
    ts = O.targets("t_target_phonics")
    has = lambda n: f"list_contains({ts}, '{n}')"
    n = f"len(list_distinct({ts}))"
    hard = f"(({has('vowel teams')} OR {has('diphthongs')} OR {has('r-controlled vowels')} OR {has('multisyllabic words')}) AND (t_target_phonics_pattern_emphasis_score = 0 OR t_target_satisfaction_rate < 0.5::double) AND t_word_count >= 40)"
    high = "(category = 'high_above_level' OR (t_above_level_rate >= 0.2::double AND t_coherence_score >= 1))"
    return f"""CASE WHEN category IN ('least_compliance_gain', 'prompt_difficulty') AND t_decodability_compliance >= 0.99::double AND b_decodability_compliance >= 0.99::double THEN {_q(errors.RULES)}
    WHEN category = 'low_decodability_adherence' AND t_decodability_compliance >= 0.9::double AND t_decodability_adherence_score = 0 THEN {_q(errors.RULES)}
    WHEN category = 'high_above_level' AND t_decodability_adherence_score >= 2 AND t_above_level_rate >= 0.2::double THEN {_q(errors.RULES)}
    WHEN (category IN ('low_coherence', 'incomplete_narrative') OR t_narrative_completeness_score = 0 OR t_coherence_score = 0) AND (t_word_count <= 40 OR t_narrative_completeness_score = 0) THEN {_q(errors.BEHAVIOR)}
    WHEN t_decodability_compliance > b_decodability_compliance + 0.05::double AND t_target_satisfaction_rate + 0.2::double < b_target_satisfaction_rate AND t_target_phonics_pattern_emphasis_score = 0 THEN {_q(errors.CONFLICT)}
    WHEN {hard} AND {n} >= 2 AND {n} >= 3 THEN {_q(errors.CAPACITY)} WHEN {hard} THEN {_q(errors.COVERAGE)} WHEN {high} AND t_weighted_above_level_rate >= 0.5::double THEN {_q(errors.COVERAGE)} WHEN {high} THEN {_q(errors.BEHAVIOR)}
    WHEN category = 'low_target_phonics_emphasis' AND t_coherence_score >= 1 AND t_word_count >= 40 THEN {_q(errors.COVERAGE)}
    ELSE CASE category {' '.join(f"WHEN '{m}' THEN {_q(c)}" for m, c in errors.DEFAULTS.items())} ELSE {_q(errors.BEHAVIOR)} END END"""


_EX = f"{_KEYS}, category, CAST(rank AS INT) AS rank, notes, compliance_delta, * EXCLUDE ({_KEYS}, category, rank, notes, compliance_delta)"
_LEAST_NOTE = "'Smallest paired compliance_delta.' || CASE WHEN compliance_delta = 0 AND t_decodability_compliance >= 0.99::double THEN ' Ceiling effect: both models already near-perfect on this metric.' WHEN t_decodability_compliance < 0.85::double THEN ' Tuned absolute compliance remains relatively weak.' ELSE '' END"
_GAIN = f"gains AS (SELECT *, 'largest_compliance_gain' AS category, 'Largest paired gain in objective decodability_compliance.' AS notes, row_number() OVER (ORDER BY compliance_delta DESC, {_KEYS}) AS rank FROM examined QUALIFY rank <= 5),\nleasts AS (SELECT *, 'least_compliance_gain' AS category, {_LEAST_NOTE} AS notes, row_number() OVER (ORDER BY compliance_delta, {_KEYS}) AS rank FROM examined QUALIFY rank <= 5)"
_MODE_ROWS = " UNION ALL ".join(
    f"SELECT *, '{m}' AS category, {_q(n)} AS note, {'-t_' + c if c == 'above_level_rate' else f't_{c}::double'} AS severity FROM examined WHERE t_{c} {'>= 0.2::double' if c == 'above_level_rate' else '<= 0'}" for m, c, n in errors.MODES
)
_MODES = f"""flagged AS MATERIALIZED ({_MODE_ROWS}),
reps AS MATERIALIZED (SELECT *, note || ' n_tuned_flagged=' || n || '/' || (SELECT count(*) FROM examined) || '.' AS notes FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY severity, t_overall_spec_adherence_score, CASE WHEN category = 'high_above_level' THEN 0::double ELSE -t_above_level_rate END, t_row_ord) AS rank, count(*) OVER (PARTITION BY category) AS n FROM flagged) WHERE rank = 1),
extras AS (SELECT * FROM (SELECT f.*, f.note || ' additional flagged example.' AS notes, row_number() OVER (PARTITION BY f.category ORDER BY f.severity, f.t_overall_spec_adherence_score, f.t_row_ord) + 1 AS rank FROM flagged f JOIN reps r ON f.category = r.category AND f.t_row_ord <> r.t_row_ord) WHERE rank <= 5)"""
_STATS = f"""stats AS MATERIALIZED (SELECT *, CAST(row_number() OVER (ORDER BY overall_spec_adherence, target_phonics_pattern_emphasis, satisfaction, decodability_adherence, above DESC, prompt_id) AS INT) AS rank FROM (SELECT t.prompt_id, arg_min(target_phonics, row_ord) AS target_phonics, count(*) AS n, {O.rounded(O.mean('decodability_compliance'))} AS tuned_compliance,
  (SELECT {O.rounded(O.mean('decodability_compliance'))} FROM judged b WHERE b.model = 'base' AND b.prompt_id = t.prompt_id) AS base_compliance, {O.rounded(O.mean('above_level_rate'))} AS above, {O.rounded(O.mean('target_satisfaction_rate'))} AS satisfaction,
  {', '.join(f"{O.mean(f'coalesce({s}, 0)')} AS {s.removesuffix('_score')}" for s in errors.SCORES)}, {', '.join(f"count(*) FILTER (coalesce({s}, 0) <= 0) AS n_low_{s.removesuffix('_score')}" for s in errors.SCORES[:4])},
  count(*) FILTER (above_level_rate >= 0.2::double) AS n_high_above FROM judged t WHERE model = 'tuned' GROUP BY t.prompt_id))"""
_HARDEST = f"""hardest AS (SELECT e.*, 'prompt_difficulty' AS category, s.rank, printf('Prompt-level difficulty rank #%d. tuned_overall=%.2f, emphasis=%.2f, tgt_sat=%.2f.', s.rank, {O.rounded('s.overall_spec_adherence', 2)}, {O.rounded('s.target_phonics_pattern_emphasis', 2)}, {O.rounded('s.satisfaction', 2)}) AS notes FROM
  (SELECT * FROM examined QUALIFY row_number() OVER (PARTITION BY prompt_id ORDER BY t_overall_spec_adherence_score, t_target_phonics_pattern_emphasis_score, t_decodability_adherence_score, t_above_level_rate DESC, t_row_ord) = 1) e JOIN stats s USING (prompt_id) WHERE s.rank <= 5)"""
_UNION = " UNION ALL ".join(f"SELECT {_KEYS}, category, CAST(rank AS INT) AS rank, notes, compliance_delta, {', '.join(f'b_{f}, t_{f}' for f in _F)} FROM {r}" for r in ("gains", "leasts", "reps", "extras", "hardest"))
_EXAMPLES = f"examples AS MATERIALIZED (SELECT *, {_cause_sql()} AS likely_cause FROM ({_UNION}))"
_TO_EXAMINED = (*TO_JUDGED, _EXAMINED)
_TO_EXAMPLES = (*_TO_EXAMINED, _GAIN, _MODES, _STATS, _HARDEST, _EXAMPLES)
_SHOWN = f"{_KEYS}, category, rank, notes, compliance_delta, base_row, tuned_row"
_SHOWN_SQL = f"SELECT {_KEYS}, category, CAST(rank AS INT) AS rank, notes, compliance_delta, b_row_ord AS base_row, t_row_ord AS tuned_row FROM "


def _shown(df: DataFrame) -> DataFrame:
    return df.select(*KEYS, "category", "rank", "notes", "compliance_delta", F.col("base.row_ord").alias("base_row"), F.col("tuned.row_ord").alias("tuned_row"))


def _examined(spark, sf_dir) -> DataFrame:
    return errors.examined_pairs(judged(spark, sf_dir))


@query(O.query(_SHOWN_SQL + "gains", *_TO_EXAMINED, _GAIN))
def gain_topk(spark, sf_dir):
    """The largest gains in compliance."""
    return _shown(errors.largest_gains(_examined(spark, sf_dir)))


@query(O.query(_SHOWN_SQL + "leasts", *_TO_EXAMINED, _GAIN))
def least_gain_topk(spark, sf_dir):
    """The smallest gains in compliance and what they mean."""
    return _shown(errors.least_gains(_examined(spark, sf_dir)))


@query(O.query(_SHOWN_SQL + "leasts ORDER BY contains(notes, 'Ceiling effect'), rank LIMIT 1", *_TO_EXAMINED, _GAIN))
def least_gain_rep(spark, sf_dir):
    """The smallest gain that is no ceiling effect."""
    return _shown(errors.least_gain_representative(_examined(spark, sf_dir)))


@query(O.query(_SHOWN_SQL + "reps", *_TO_EXAMINED, _MODES))
def failure_representatives(spark, sf_dir):
    """The worst pair of each failure mode."""
    return _shown(errors.representatives(_examined(spark, sf_dir)))


_TRIM = O.strip("coalesce(t_story, '')")


@query(O.query(rf"SELECT {_KEYS}, category, CAST(rank AS INT) AS rank, notes, CASE WHEN length(s) <= 200 THEN s ELSE regexp_replace(left(s, 199), '\s+$', '') || '…' END AS tuned_story FROM (SELECT *, replace({_TRIM}, chr(13) || chr(10), chr(10)) AS s FROM extras)", *_TO_EXAMINED, _MODES))
def failure_extras(spark, sf_dir):
    """More pairs of each failure mode, with the start of the story."""
    out = errors.extras(errors.examined_pairs(judged(spark, sf_dir)))
    story = stories(spark, sf_dir).select(F.col("row_ord").alias("__row"), "story")
    out = story.join(F.broadcast(out), F.col("__row") == F.col("tuned.row_ord"))  # out: four rows for each mode
    return out.select(*KEYS, "category", "rank", "notes", truncate(F.col("story"), 200).alias("tuned_story"))


_STAT_COLS = "prompt_id, target_phonics, n, tuned_compliance, base_compliance, above, satisfaction, " + ", ".join(s.removesuffix("_score") for s in errors.SCORES) + ", " + ", ".join(f"n_low_{s.removesuffix('_score')}" for s in errors.SCORES[:4]) + ", n_high_above, rank"


@query(O.query(f"SELECT {_STAT_COLS} FROM stats", *TO_JUDGED, _STATS))
def prompt_difficulty(spark, sf_dir):
    """Figures and difficulty rank of each prompt."""
    return errors.prompt_stats(judged(spark, sf_dir)).select(*_STAT_COLS.split(", "))


@query(O.query(_SHOWN_SQL + "hardest", *_TO_EXAMINED, _STATS, _HARDEST))
def hardest_prompt_examples(spark, sf_dir):
    """The worst pair of each of the hardest prompts."""
    df = judged(spark, sf_dir)
    return _shown(errors.hardest_examples(df, errors.examined_pairs(df)))


_CONDITION_TESTS = ["list_contains(ts, 'vowel teams')", "list_contains(ts, 'diphthongs')", "list_contains(ts, 'r-controlled vowels')", "list_contains(ts, 'multisyllabic words')", "len(list_distinct(ts)) >= 2", "len(list_distinct(ts)) < 2", "TRUE"]
_CONDITION_MEANS = {"mean_decodability_compliance": "decodability_compliance", "mean_above_level_rate": "above_level_rate", "mean_target_satisfaction": "target_satisfaction_rate", "mean_decodability_adherence": "coalesce(decodability_adherence_score, 0)", "mean_target_phonics_pattern_emphasis": "coalesce(target_phonics_pattern_emphasis_score, 0)", "mean_overall_spec_adherence": "coalesce(overall_spec_adherence_score, 0)"}
_CONDITION_SHARES = {"pct_low_emphasis": "target_phonics_pattern_emphasis_score", "pct_low_decod_subj": "decodability_adherence_score", "pct_incomplete": "narrative_completeness_score"}
_CONCENTRATION = f"tuned AS MATERIALIZED (SELECT *, {O.targets('target_phonics')} AS ts FROM judged WHERE model = 'tuned'),\nconcentrated AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT {_q(c)} AS condition, count(*) AS n_outputs, {O.rounded('count(*)::double / greatest((SELECT count(*) FROM tuned), 1)')} AS share_of_tuned, {', '.join(f'CASE WHEN count(*) > 0 THEN {O.rounded(O.mean(e))} END AS {n}' for n, e in _CONDITION_MEANS.items())}, {', '.join(f'CASE WHEN count(*) > 0 THEN {O.rounded(f'(count(*) FILTER (coalesce({s}, 0) <= 0))::double / greatest(count(*), 1)')} END AS {n}' for n, s in _CONDITION_SHARES.items())} FROM tuned WHERE {t}"
    for c, t in zip(errors.CONDITIONS, _CONDITION_TESTS, strict=True)
) + ")"


@query(O.query("SELECT * FROM concentrated", *TO_JUDGED, _CONCENTRATION))
def concentration(spark, sf_dir):
    """Figures of the tuned rows under overlapping conditions."""
    return errors.concentration(judged(spark, sf_dir))


@query(O.query(f"SELECT *, worse_emphasis OR worse_decodability OR worse_overall AS harder FROM (SELECT c.condition, c.pct_low_emphasis > a.pct_low_emphasis + 0.05::double AS worse_emphasis, c.pct_low_decod_subj > a.pct_low_decod_subj + 0.05::double AS worse_decodability, c.mean_overall_spec_adherence + 0.05::double < a.mean_overall_spec_adherence AS worse_overall FROM concentrated c, concentrated a WHERE a.condition = {_q(errors.CONDITIONS[-1])} AND c.condition <> a.condition AND c.n_outputs > 0)", *TO_JUDGED, _CONCENTRATION))
def concentration_verdicts(spark, sf_dir):
    """Conditions that look harder than the average."""
    return errors.verdicts(errors.concentration(judged(spark, sf_dir)))


@query(O.query(f"SELECT {_KEYS}, category, rank, likely_cause, notes FROM examples", *_TO_EXAMPLES))
def likely_cause(spark, sf_dir):
    """All examples with their likely cause."""
    return errors.all_examples(judged(spark, sf_dir)).select(*KEYS, "category", "rank", "likely_cause", "notes")


@query(O.query("SELECT likely_cause, count(*) AS n FROM examples WHERE rank = 1 AND category <> 'largest_compliance_gain' GROUP BY likely_cause", *_TO_EXAMPLES))
def cause_tally(spark, sf_dir):
    """How often each cause explains the worst examples."""
    return errors.cause_tally(errors.all_examples(judged(spark, sf_dir)))


@query(O.query("SELECT category, count(*) AS n, count(DISTINCT prompt_id) AS prompts FROM examples GROUP BY category", *_TO_EXAMPLES))
def examples_union(spark, sf_dir):
    """Examples of each category under each other."""
    return errors.all_examples(judged(spark, sf_dir)).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("prompt_id").alias("prompts"))


@query(O.query("SELECT row_ord, model, CAST(row_number() OVER (ORDER BY row_ord) AS INT) AS place FROM (SELECT * FROM stories ORDER BY row_ord LIMIT 20)", O.STORIES))
def ordered_limit(spark, sf_dir):
    """The first rows in input order, as a smoke run takes them."""
    first = stories(spark, sf_dir).orderBy("row_ord").limit(20).withColumn("__one", F.lit(1))
    return errors.top(first, ["__one"], [F.col("row_ord")], 20, "place").select("row_ord", "model", "place")
