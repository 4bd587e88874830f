"""Markdown and console output of small result tables."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyscale.operators import errors
from storyscale.sources.shared import stored, work_dir


def cell(x) -> str:
    return "n/a" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)


def percent(x: float | None) -> str:
    return "n/a" if x is None else f"{100.0 * x:.1f}%"


def markdown(df: DataFrame, columns: list[str] | None = None) -> str:
    """A markdown table of all rows."""
    names = columns or df.columns
    rows = df.select(*names).toLocalIterator()
    clean = lambda x: cell(x).replace("|", "\\|").replace("\n", " ")
    return "\n".join(["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *("| " + " | ".join(map(clean, r)) + " |" for r in rows)])


def console(df: DataFrame, title: str, columns: list[str] | None = None) -> str:
    """A table of left-justified columns as wide as their longest cell."""
    names = columns or df.columns
    rows = [[cell(x) for x in r] for r in df.select(*names).toLocalIterator()]
    if not rows:
        return f"{title}\n{'-' * len(title)}\n(no rows)\n"
    widths = [max(len(n), *(len(r[i]) for r in rows)) for i, n in enumerate(names)]
    line = lambda cells: "  ".join(c.ljust(w) for c, w in zip(cells, widths))
    return "\n".join([title, "-" * len(title), line(names), line(["-" * w for w in widths]), *map(line, rows), ""])


#: What the failure modes and causes stand for, as the report says it.
MODE_NOTES = {m: n for m, _, n in errors.MODES}
CAUSE_NOTES = {
    errors.COVERAGE: "a hard pattern family, or a target hardly practised, in a story that is long enough",
    errors.CONFLICT: "the tuned story keeps to the level but loses requested patterns that the base story has",
    errors.CAPACITY: "three or more advanced targets asked for at once, met weakly together",
    errors.BEHAVIOR: "a story that is incomplete, incoherent or very short",
    errors.RULES: "both stories already near the top of a metric, or the metrics and the judge far apart",
}


def _texts(df: DataFrame, rows: list[int]) -> dict[int, dict]:
    """Story and judge's notes of a few rows."""
    wanted = ["story", *[c for c in df.columns if c.endswith("_justification")]]
    found = df.where(F.col("row_ord").isin(rows)).select("row_ord", *[c for c in wanted if c in df.columns])
    return {r["row_ord"]: r.asDict() for r in found.toLocalIterator()}


def _figures(side: str, x) -> str:
    scores = [f"{c.removesuffix('_score').replace('_', ' ')} {x[c]}" for c in errors.SCORES] if side == "Tuned" else []
    told = [f"compliance {cell(x['decodability_compliance'])}", f"above level {percent(x['above_level_rate'])}", f"weighted above level {cell(x['weighted_above_level_rate'])}", f"target satisfaction {percent(x['target_satisfaction_rate'])}", f"{x['word_count']} words"]
    return f"- {side}: {', '.join([*told, *scores])}"


def _fenced(text: str | None) -> str:
    """A story as a block that its own fences don't end."""
    text = text or ""
    fence = "`" * max([2, *map(len, re.findall("`+", text))]) + "`"
    return f"{fence}text\n{text}\n{fence}"


def _example(r, texts: dict[int, dict]) -> str:
    """A pair with the figures of both sides, its likely cause, the judge's notes and both stories."""
    b, t = r["base"], r["tuned"]
    tuned, base = (texts.get(x["row_ord"], {}) for x in (t, b))
    notes = [f"- Judge on {c.removesuffix('_justification').replace('_', ' ')}: {v}" for c, v in tuned.items() if c.endswith("_justification") and v]
    lines = [f"### {r['category']} #{r['rank']}: {' / '.join(str(r[k]) for k in errors.KEYS)}", "", f"{r['notes']} Likely cause: {r['likely_cause']}.", "", _figures("Tuned", t), _figures("Base", b), f"- Difference in compliance: {cell(r['compliance_delta'])}", *notes]
    if "story" in tuned or "story" in base:
        lines += ["", "Tuned story:", "", _fenced(tuned.get("story")), "", "Base story:", "", _fenced(base.get("story"))]
    return "\n".join(lines)


def _table(names: list[str], rows: list[list]) -> str:
    clean = lambda x: cell(x).replace("|", "\\|").replace("\n", " ")
    return "\n".join(["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *("| " + " | ".join(map(clean, r)) + " |" for r in rows)])


def _ranked(examples: list, category: str, *more: str) -> str:
    rows = [[r["rank"], *[r[k] for k in errors.KEYS], r["base"]["decodability_compliance"], r["tuned"]["decodability_compliance"], r["compliance_delta"], *[r[m] for m in more], r["likely_cause"]] for r in examples if r["category"] == category]
    return _table(["rank", *errors.KEYS, "base", "tuned", "difference", *more, "likely cause"], rows)


def _verdicts(table: list, verdicts: list) -> str:
    """A sentence for each condition: whether and by what it looks harder than all tuned rows."""
    of = {r["condition"]: r for r in table}
    whole, out = of[errors.CONDITIONS[-1]], []
    for v in verdicts:
        c = of[v["condition"]]
        why = []
        if v["worse_emphasis"]:
            why.append(f"low emphasis in {percent(c['pct_low_emphasis'])} of stories, {percent(whole['pct_low_emphasis'])} overall")
        if v["worse_decodability"]:
            why.append(f"low decodability adherence in {percent(c['pct_low_decod_subj'])}, {percent(whole['pct_low_decod_subj'])} overall")
        if v["worse_overall"]:
            why.append(f"mean overall adherence {c['mean_overall_spec_adherence']:.2f}, {whole['mean_overall_spec_adherence']:.2f} overall")
        out.append(f"- {v['condition']}: harder than average ({'; '.join(why)})." if why else f"- {v['condition']}: not clearly harder than average.")
    return "\n".join(out)


def error_report(df: DataFrame) -> str:
    """The failure report of judged rows: gains, failures, difficulty, concentration, causes.

    A few rows of each ranking come to the driver, and the texts of the representatives among them.
    """
    spark = df.sparkSession
    numbers = stored(df.drop(*[c for c in df.columns if c in ("story", "prompt") or c.endswith(("_justification", "_json"))]), work_dir(spark, "report"))
    pairs = stored(errors.examined_pairs(numbers), work_dir(spark, "pairs"))
    stats = errors.prompt_stats(numbers)
    cols = [*errors.KEYS, "category", "rank", "notes", "compliance_delta", "base", "tuned"]
    found = errors.pair_examples(pairs)
    both = found.unionByName(errors.hardest_examples(numbers, pairs, stats=stats).select(cols), allowMissingColumns=True)
    examples = both.withColumn("likely_cause", errors.likely_cause(F.col("category"))).orderBy("category", "rank").collect()  # five or so of each category
    firsts = [r for r in examples if r["rank"] == 1]
    least = [r for r in examples if r["category"] == errors.GAINS[1]]
    told = next((r for r in least if "Ceiling effect" not in r["notes"]), least[0] if least else None)
    shown = [told if r["category"] == errors.GAINS[1] else r for r in firsts]
    texts = _texts(df, [x["row_ord"] for r in shown for x in (r["base"], r["tuned"])])
    table = errors.concentration(numbers).collect()  # seven conditions
    judged = spark.createDataFrame(table) if table and table[-1]["n_outputs"] is not None and any(r["n_outputs"] for r in table) else None
    verdicts = errors.verdicts(judged).collect() if judged is not None else []
    mode = {r["category"]: r for r in firsts}
    modes = [[m, mode[m]["n"] if m in mode else 0, percent(mode[m]["n"] / mode[m]["of"]) if m in mode else percent(0.0), mode[m]["prompt_id"] if m in mode else "none", mode[m]["likely_cause"] if m in mode else "none", n] for m, n in MODE_NOTES.items()]
    causes = Counter(r["likely_cause"] for r in firsts if r["category"] != errors.GAINS[0])
    hardest = stats.where("rank = 1").collect()
    parts = [
        ("How to read this", f"Differences are tuned less base. A score of 0 is low; {percent(errors.HIGH_ABOVE)} of words above level or more is high. Causes are guesses from these figures alone, to be looked into, and prove nothing about the training data."),
        ("Largest gains", _ranked(examples, errors.GAINS[0])),
        ("Smallest gains", _ranked(examples, errors.GAINS[1], "notes")),
        ("Failure modes", _table(["mode", "flagged", "share of pairs", "worst pair's prompt", "likely cause", "definition"], modes)),
        ("Prompt difficulty", markdown(stats.orderBy("rank")) + ("\n\n" + f"Most difficult prompt: {hardest[0]['prompt_id']} ({hardest[0]['target_phonics']})." if hardest else "")),
        ("Concentration", _table(table[0].__fields__, [list(r) for r in table])),
        ("Conditions harder than average", _verdicts(table, verdicts)),
        ("Examples", "\n\n".join(_example(r, texts) for r in shown)),
        ("Likely causes", _table(["likely cause", "representatives", "means"], [[c, n, CAUSE_NOTES[c]] for c, n in causes.most_common()])),
    ]
    return "\n\n".join(f"## {t}\n\n{body}" for t, body in parts) + "\n"


def interpretation(flags: DataFrame, hardest: DataFrame) -> str:
    """What the tuned model improved and worsened, and its hardest prompts, in words (of ``rollup.interpretation`` and ``rollup.hardest_prompts``)."""
    rows = flags.collect()  # a row for each metric
    if any(r["n_base"] == 0 or r["n_tuned"] == 0 for r in rows):
        return "No interpretation: base or tuned rows are missing.\n"
    out = ["Tuned against base, as estimated; the judge doesn't know the model."]
    for family, digits in (("objective", 3), ("judge", 2)):
        for verdict in ("improved", "regressed"):
            told = [f"  - {r['metric'].removeprefix('mean_').replace('_', ' ')}: {r['b']:.{digits}f} to {r['t']:.{digits}f}" for r in rows if (r["family"], r["verdict"]) == (family, verdict)]
            out += [f"{verdict.capitalize()} by the {'metrics' if family == 'objective' else 'judge'}:", *(told or ["  - nothing clear"])]
    means = [c for c in hardest.columns if c.startswith("mean_")]
    out += ["Hardest prompts of the tuned model:", *[f"  - {r['prompt_id']}: " + ", ".join(f"{c.removeprefix('mean_').replace('_', ' ')} {r[c]:.2f}" for c in means) for r in hardest.collect()]]  # three rows
    return "\n".join(out) + "\n"
