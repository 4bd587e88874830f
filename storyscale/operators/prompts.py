"""Generation prompts from target lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyscale.functions.lexicon import EXAMPLES, PROMPT_IDS, TARGET_LISTS

CASES = list(zip(PROMPT_IDS, TARGET_LISTS, strict=True))

# fixed values: the wording around the lists
HEAD = "Write a decodable story.\n\nEmphasize these phonics patterns:\n"
MIDDLE = "\n\nHere are some example words containing these patterns:\n"
TAIL = (
    "\n\nUse the example words only as guidance. You may use other words that contain the same patterns.\n"
    "Write a coherent narrative with a clear beginning, middle, and ending.\n"
    "Include a natural story title.\n"
    "Do not mention phonics terms or pattern names in the title or story."
)


def build(targets: Column) -> Column:
    """The prompt of an array of target names."""
    words = F.create_map(*[F.lit(x) for d, w in EXAMPLES.items() for x in (d, ", ".join(w))])
    names = F.array_join(F.transform(targets, lambda t: F.concat(F.lit("- "), t)), "\n")
    examples = F.array_join(F.transform(targets, lambda t: F.concat(F.lit("- "), t, F.lit(": "), F.element_at(words, t))), "\n")
    return F.concat(F.lit(HEAD), names, F.lit(MIDDLE), examples, F.lit(TAIL))


def oracle(targets: str) -> str:
    """The same in DuckDB SQL."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    words = "CASE t " + " ".join(f"WHEN {q(d)} THEN {q(', '.join(w))}" for d, w in EXAMPLES.items()) + " END"
    return f"{q(HEAD)} || array_to_string(list_transform({targets}, lambda t: '- ' || t), chr(10)) || {q(MIDDLE)} || array_to_string(list_transform({targets}, lambda t: '- ' || t || ': ' || {words}), chr(10)) || {q(TAIL)}"
