"""Structured judge scores: messages, parsing and validation of payloads, resumable scoring.

Validation is one expression over the payload text, so it runs inside the plan. Scoring with an
outside judge goes through a log of responses (``judgelog``); the judge is any callable of messages to
text.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from storyscale.functions import rubrics
from storyscale.functions.lexicon import DIMENSIONS, STORY_DIMENSIONS
from storyscale.functions.text import strip
from storyscale.operators import ordered
from storyscale.sources import judgelog

CONSISTENCY = ("consistency",)


def extract_object(x: Column) -> Column:
    """The JSON object of a response: that of a code fence, else from the first to the last brace; null without one."""
    t = strip(F.coalesce(x, F.lit("")))
    fenced = F.regexp_extract(t, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    start, end = F.locate("{", t), F.length(t) - F.locate("}", F.reverse(t)) + 1
    has = (start > 0) & (F.locate("}", t) > 0) & (end > start)
    return F.when(fenced != "", fenced).when(has, F.substring(t, start, end - start + 1))


def first_sentence(x: Column) -> Column:
    t = strip(x)
    return strip(F.get(F.split(t, r"(?U)(?<=[.!?])\s+", 2), F.lit(0)))


def validate(df: DataFrame, payload: str, dims: tuple[str, ...]) -> DataFrame:
    """``df`` with <dim>_score and <dim>_justification, raw_json and error (the first reason to reject, else null).

    A score must be a JSON number, whole, 0 to 2; a justification must not be blank and is cut to
    its first sentence. A rejected payload has null scores.
    """
    text = F.col(payload)
    df = df.withColumn("__object", extract_object(text)).withColumn("__json", F.try_parse_json("__object"))
    error = F.when(strip(F.coalesce(text, F.lit(""))) == "", "empty response").when(F.col("__object").isNull(), "no object").when(F.col("__json").isNull(), "invalid JSON")
    # what each dimension holds, and its own verdict, stand in columns of their own: shared by all tests, and small code
    part = lambda d, p: F.try_variant_get("__json", f"$.{d}{p}", "variant")
    df = df.withColumns({f"__{d}{k}": F.schema_of_variant(part(d, p)) for d in dims for k, p in (("", ""), ("_kind", ".score"), ("_told", ".justification"))})
    df = df.withColumns({f"__{d}_score": F.try_variant_get("__json", f"$.{d}.score", "double") for d in dims} | {
        f"__{d}_said": F.when(F.col(f"__{d}_told") == "VOID", F.lit("None")).otherwise(strip(F.coalesce(F.try_variant_get("__json", f"$.{d}.justification", "string"), F.lit("")))) for d in dims
    })
    df = df.withColumns({
        f"__{d}_error": F.when(F.col(f"__{d}").isNull(), f"{d}: missing")
        .when(~F.col(f"__{d}").startswith("OBJECT"), f"{d}: not an object")
        .when(F.col(f"__{d}_kind").isNull() | F.col(f"__{d}_told").isNull(), f"{d}: missing field")
        .when(~F.col(f"__{d}_kind").rlike("^(BIGINT|DOUBLE|DECIMAL.*)$"), f"{d}: score not numeric")
        .when(~F.col(f"__{d}_score").isin(0.0, 1.0, 2.0), f"{d}: score out of range")
        .when(F.col(f"__{d}_said") == "", f"{d}: blank justification")
        for d in dims
    })
    df = df.withColumn("error", F.coalesce(error, *[F.col(f"__{d}_error") for d in dims]))
    made = {f"{d}_score": F.col(f"__{d}_score").cast("int") for d in dims} | {f"{d}_justification": first_sentence(F.col(f"__{d}_said")) for d in dims}
    df = df.withColumns({k: F.when(F.col("error").isNull(), v) for k, v in made.items()})
    raw = F.to_json(F.struct(*[F.struct(F.col(f"{d}_score").alias("score"), F.col(f"{d}_justification").alias("justification")).alias(d) for d in dims]))
    return df.withColumn("raw_json", F.when(F.col("error").isNull(), raw)).drop("__object", "__json", *[f"__{d}{k}" for d in dims for k in ("", "_kind", "_told", "_score", "_said", "_error")])


def subjective_total(dims: tuple[str, ...] = DIMENSIONS) -> Column:
    """Sum of a row's scores; null of an unjudged row."""
    return sum((F.col(f"{d}_score") for d in dims), F.lit(0))


def present(df: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` is not null, by exploding it.

    A plain filter on a column of ``validate`` would be pushed below it, with all its expressions
    copied into the condition.
    """
    return df.withColumn(column, F.explode(F.array_compact(F.array(column))))


# -- messages: the judge never sees the model's name ----------------------------------------------

_ROLE = "You evaluate decodable stories for early readers against the requested patterns and the behavior specification alone. Nothing tells which model wrote a story; do not infer it. Answer with JSON alone, of the keys shown and no others."


def _schema(dims: tuple[str, ...]) -> str:
    return "{" + ", ".join(f'"{d}": {{"score": 0, "justification": "..."}}' for d in dims) + "}"


def _asked(dims: tuple[str, ...]) -> str:
    """The scales of the dimensions and the shape of the answer."""
    scales = "\n".join(f"- {d}: {rubrics.SCALES[d]}" for d in dims)
    return f"\n\nScore each dimension as a whole number from 0 to 2, with one short sentence of justification:\n{scales}\n\nReturn JSON exactly like:\n{_schema(dims)}"


def _message(*parts: Column) -> Column:
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(_ROLE).alias("content")), F.struct(F.lit("user").alias("role"), F.concat(*parts).alias("content")))


#: What stands before the story in the messages of either kind of judgement, by its dimensions.
SPECIFIED = {STORY_DIMENSIONS: rubrics.STORY_BEHAVIOR, DIMENSIONS: f"Behavior specification:\n{rubrics.BEHAVIOR}\n\n{rubrics.HIERARCHY}\n\n{rubrics.PRIORITIES}"}


def story_parts(dims: tuple[str, ...] = STORY_DIMENSIONS) -> tuple[str, str, str, str]:
    """The fixed text of a story's user message: before the targets, the prompt and the story, and behind it."""
    return f"{SPECIFIED[dims]}\n\nTarget phonics: ", "\n\nGeneration prompt (context only):\n", "\n\nStory to evaluate:\n", _asked(dims)


def story_messages(target: Column, prompt: Column, story: Column, dims: tuple[str, ...] = STORY_DIMENSIONS) -> Column:
    """Chat messages that ask for a score of 0 to 2 and one sentence in each dimension."""
    a, b, c, d = map(F.lit, story_parts(dims))
    return _message(a, target, b, prompt, c, story, d)


#: Between the generations of a consistency message, and what stands before them.
GAP = "\n\n---\n\n"
TOLD = "\n\nGenerations for the same prompt by one model, to be judged for whether they are stably readable at the requested level:\n\n"


def consistency_asked() -> str:
    """What stands behind the generations."""
    return _asked(CONSISTENCY)


def _generation() -> Column:
    return F.concat(F.lit("[generation_id="), F.col("generation_id"), F.lit("]\n"), F.col("story"))


def consistency_messages(df: DataFrame) -> DataFrame:
    """model, prompt_id and messages over all generations of a prompt, ordered by generation id as text.

    The generations are folded in a stream; only the message, which a judge reads at once, is whole.
    """
    rows = df.select("model", "prompt_id", "generation_id", "target_phonics", "prompt", "row_ord", _generation().alias("part"))
    gap = GAP
    groups = ordered.folded(rows, ["model", "prompt_id"], ["generation_id", "row_ord"], lambda: ordered.Joined(gap, 2), "n long, target_phonics string, prompt string, joined string")
    return groups.select("model", "prompt_id", _message(*_before("target_phonics", "prompt"), F.col("joined"), F.lit(consistency_asked())).alias("messages"))


def _before(target: str, prompt: str) -> list[Column]:
    """What stands before the generations."""
    return [F.lit("Target phonics: "), F.col(target), F.lit("\n\nGeneration prompt (context only):\n"), F.col(prompt), F.lit(TOLD)]


def group_digests(df: DataFrame) -> DataFrame:
    """model, prompt_id and the rows, characters, bytes and CRC-32 of all generations as a consistency message joins them."""
    return ordered.joined_digest(df, ["model", "prompt_id"], ["generation_id", "row_ord"], _generation(), GAP)


# -- scoring --------------------------------------------------------------------------------------

#: Content of messages is text. To a judge with a true attribute ``reads_parts`` it may come in pieces, as an iterator of texts, where it is long.
Judge = Callable[[list[dict]], str]


def doubling(attempt: int) -> float:
    """Seconds to wait after a failure: twice as long each time, 20 at most."""
    return float(min(2**attempt, 20))


def _object(text: str) -> str:
    """As ``extract_object``."""
    fenced = re.search(r"```(?:json)?\s*(\{.*?\})\s*```", text, re.DOTALL)
    return fenced[1] if fenced else text[text.index("{") : text.rindex("}") + 1]


def _once(pairs: list[tuple]) -> dict:
    if len(dict(pairs)) < len(pairs):
        raise ValueError("a key is repeated")
    return dict(pairs)


def acceptable(dims: tuple[str, ...]) -> Callable[[str], bool]:
    """Whether ``validate`` takes a response, for asking again at once."""

    def accept(text: str) -> bool:
        try:
            told = json.loads(_object(text), object_pairs_hook=_once, parse_constant=int)
            return all(type(told[d]["score"]) in (int, float) and told[d]["score"] in (0, 1, 2) and str(told[d]["justification"]).strip() for d in dims)
        except (ValueError, KeyError, TypeError):
            return False

    return accept


def call(judge: Judge, messages: list[dict], accept: Callable[[str], bool], retries: int = 4, pause: float | Callable[[int], float] = 0.6, sleep: Callable[[float], None] = time.sleep) -> str:
    """A response that ``accept`` takes; waits longer after each failure (pause seconds more each time, or as a function tells), and raises after the last."""
    for attempt in range(retries):
        try:
            if accept(out := judge(messages)):
                return out
            why = "rejected response"
        except Exception as e:  # the judge is an outside service
            why = repr(e)
        sleep(pause(attempt) if callable(pause) else pause * (attempt + 1))
    raise RuntimeError(f"the judge failed {retries} times: {why}")


def resume_split(df: DataFrame, scored: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(rows that are scored already, rows that are still to judge)."""
    done = scored.select(*keys).distinct()
    return df.join(done, list(keys), "left_semi"), df.join(done, list(keys), "left_anti")


def _asking(judge: Judge, accept: Callable[[str], bool], pause: float, retries: int, wait: float | Callable[[int], float]) -> Callable[[list[dict]], str]:
    """Asks as ``call`` does. Pieces pass once: a judge that reads them is asked again when Spark runs the task again."""
    parts = getattr(judge, "reads_parts", False)

    def ask(messages: list[dict]) -> str:
        passing = any(isinstance(m["content"], Iterator) for m in messages)
        if passing and not parts:
            messages = [m | {"content": "".join(m["content"])} for m in messages]
        out = call(judge, messages, accept, 1 if passing and parts else retries, wait)
        time.sleep(pause)
        return out

    return ask


def judge_with_log(
    spark: SparkSession,
    df: DataFrame,
    judge: Judge,
    log: str,
    keys: tuple[str, ...] = ("model", "prompt_id", "generation_id", "seed"),
    accept: Callable[[str], bool] = bool,
    pause: float = 0.2,
    limit: int | None = None,
    retries: int = 4,
    wait: float | Callable[[int], float] = 0.6,
    **how,
) -> DataFrame:
    """The log's responses, one for each key, after asking about keys that it lacks (``limit`` of them at most, in input order).

    ``pause`` follows each response, ``wait`` each of ``retries`` failures. See ``judgelog`` for what a run
    that breaks off loses.
    """
    return judgelog.fill(spark, df, log, keys, _asking(judge, accept, pause, retries, wait), [c for c in ("row_ord",) if c in df.columns], limit, **how)


def _pieces(before: str, rows: Iterator[Row]) -> Iterator[str]:
    """A consistency message bit by bit: a generation counts behind a row that calls it judged."""
    yield before
    judged, gap = None, ""
    for r in rows:
        if r["judged"]:
            judged = (r["generation_id"],)
        elif judged == (r["generation_id"],):
            yield gap + (r["part"] or "")
            gap = GAP
    yield consistency_asked()


def _in_pieces(head: Row, rows: Iterator[Row]) -> list[dict]:
    before = head["before"]
    return [{"role": "system", "content": _ROLE}, {"role": "user", "content": before if before is None else _pieces(before, rows)}]


def consistency_with_log(spark: SparkSession, df: DataFrame, judged: DataFrame, judge: Judge, log: str, accept: Callable[[str], bool] = bool, pause: float = 0.2, retries: int = 4, wait: float | Callable[[int], float] = 0.6, **how) -> DataFrame:
    """The log's responses to ``consistency_messages`` over the rows of ``df`` that ``judged`` (model, prompt_id, generation_id, as text) has.

    Generations pass to their message in a stream: the message stands nowhere as a whole, unless the
    judge reads it so.
    """
    keys, place = ("model", "prompt_id"), ("model", "prompt_id", "generation_id")
    told = judgelog.with_turn(judged, keys, [], F.col("generation_id").cast("string").alias("generation_id"))
    at = F.struct(F.col("row_ord").isNull(), "row_ord")
    rows = judgelog.with_turn(df, place, [], "row_ord", "target_phonics", "prompt").drop("turn")
    first = rows.join(told.hint("merge"), judgelog.same(rows, told, place), "left_semi").groupBy(*keys).agg(F.min_by(F.struct("target_phonics", "prompt"), at).alias("of"))
    turns = first.select(*keys, F.struct(*keys).alias("turn"), F.concat(*_before("of.target_phonics", "of.prompt")).alias("before"))
    parts = judgelog.with_turn(df, keys, [], F.col("generation_id").cast("string").alias("generation_id"), F.lit(False).alias("judged"), "row_ord", _generation().alias("part"))
    both = told.withColumn("judged", F.lit(True)).unionByName(parts, allowMissingColumns=True).drop(*keys)
    return judgelog.fill_turns(spark, turns, both, log, keys, _asking(judge, accept, pause, retries, wait), _in_pieces, ["generation_id", F.col("judged").desc(), "row_ord"], **how)


def merge_final(objective: DataFrame, subjective: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Subjective rows with the objective columns of their keys; of a column on both sides the subjective one."""
    own = [c for c in objective.columns if c not in subjective.columns or c in keys]
    return subjective.join(objective.select(*own), list(keys), "left")
