"""Fixed values of the reading-level rules: spelling patterns, word lists, names, stages, terms.

They must equal those of the rules that results are compared with, so they stand here as they are.
"""

from __future__ import annotations

# fixed values: spelling patterns
DIGRAPHS = "sh ch th wh ph ck ng".split()
INITIAL_BLENDS = "bl br cl cr dr fl fr gl gr pl pr sc sk sl sm sn sp st sw tr tw scr shr spl spr squ str thr".split()
FINAL_BLENDS = "ft ld lf lk lp lt mp nd nt pt sk sp st ct".split()
VOWEL_TEAMS = "ai ay ee ea oa oe ie igh ue ui oo ew".split()
DIPHTHONGS = "oi oy ou ow au aw".split()
R_CONTROLLED = "ar er ir or ur".split()
L_CONTROLLED = "all alk al".split()

# fixed values: words that no spelling rule covers
IRREGULAR_WORDS = (
    "a again against any are because been both buy come could do does done eye friend from give gone good great have here house into "
    "live love many move of one once only other our people put said says school should some the their there these they though thought "
    "through to two very walk want was water were what where who why would you your"
).split()
OW_LONG_O = "blow bowl crow flow glow grow know low mow own row show slow snow throw window yellow".split()
FINAL_E_EXCEPTIONS = "are come done give gone have live love move one some there these were".split()

# fixed values: pattern names in the order of their bits, their reading levels, tie order and stages
PATTERNS = ("digraph", "blend", "final_e", "vowel_team", "r_controlled", "l_controlled", "diphthong", "multisyllabic")
LEVELS = {"digraph": 3, "blend": 3, "final_e": 4, "vowel_team": 5, "r_controlled": 6, "l_controlled": 6, "diphthong": 7, "multisyllabic": 8}
TIE_ORDER = {"multisyllabic": 8, "diphthong": 7, "r_controlled": 6, "l_controlled": 6, "vowel_team": 5, "final_e": 4, "digraph": 3, "blend": 3}
STAGES = {"short_vowel": 1, "blend": 2, "digraph": 2, "final_e": 3, "vowel_team": 4, "r_controlled": 5, "l_controlled": 5, "diphthong": 6, "multisyllabic": 7}

# fixed values: display names, in the order that decides a ceiling's label
DISPLAY = {
    "short_vowel": "short-vowel words",
    "blend": "consonant blends",
    "digraph": "consonant digraphs",
    "final_e": "final-e words",
    "vowel_team": "vowel teams",
    "r_controlled": "r-controlled vowels",
    "diphthong": "diphthongs",
    "multisyllabic": "multisyllabic words",
}
L_CONTROLLED_DISPLAY = "l-controlled vowels"

# fixed values: distinct words of a pattern that pass it, and targets that a story is given at most
PASS_WORDS = 4
MAX_TARGETS = 3

# fixed values: wording that gives the exercise away, and endings of unfinished text
LEAKAGE_TERMS = ("phonics", "short vowel", "final e", "magic e", "vowel team", "digraph", "consonant blend", "r-controlled", "r controlled", "diphthong", "multisyllabic")
TRAILERS = ("...", "…", " -", " —", " –", '"', "'", ",", ";", ":", "(", "[", "{")
MID_PHRASE = "and but or the a an to of with for".split()

# fixed values: example words of the generation prompts
EXAMPLES = {
    "short-vowel words": ("cat", "sit", "red", "hop"),
    "consonant blends": ("stop", "frog", "black", "plant"),
    "consonant digraphs": ("ship", "fish", "that", "chop"),
    "final-e words": ("cake", "bike", "home", "smile"),
    "vowel teams": ("rain", "seed", "boat", "play"),
    "r-controlled vowels": ("farm", "bird", "corn", "turn"),
    "diphthongs": ("coin", "out", "toy", "cloud"),
    "multisyllabic words": ("rabbit", "family", "dinosaur", "computer"),
}

# fixed values: target lists of the evaluation prompts
TARGET_LISTS = (
    "short-vowel words",
    "consonant blends, consonant digraphs",
    "final-e words, consonant blends",
    "vowel teams, consonant digraphs",
    "r-controlled vowels, consonant blends",
    "diphthongs, consonant digraphs",
    "multisyllabic words, vowel teams, r-controlled vowels",
)
PROMPT_IDS = ("short_vowels_1", "blends_digraphs_1", "final_e_blends_1", "vowel_teams_digraphs_1", "r_controlled_blends_1", "diphthongs_digraphs_1", "multisyllabic_vowel_teams_r_controlled_1")

# fixed values: metrics of the summaries with their titles
METRICS = {
    "decodability_compliance": "Decodability compliance",
    "distinct_decodability_compliance": "Distinct-word decodability compliance",
    "above_level_rate": "Above-level rate",
    "weighted_above_level_rate": "Weighted above-level rate",
    "mean_above_level_distance": "Mean above-level distance",
    "phonics_leakage_rate": "Phonics leakage rate",
    "title_rate": "Title present rate",
    "no_duplicate_sentences": "No duplicate sentences rate",
    "complete_output": "Complete output rate",
    "word_count": "Mean word count",
    "sentence_count": "Mean sentence count",
}
SECONDARY = {"target_phonics_coverage": "Target phonics coverage (secondary; advanced text can inflate)"}
JUDGE_METRICS = {
    "spec_adherence_score": "Spec adherence",
    "robustness_score": "Robustness",
    "task_quality_score": "Task quality",
    "consistency_score": "Consistency",
}
SECONDARY_NOTE = "Secondary diagnostic only. Not a primary success metric. Advanced/above-level stories can inflate coverage by containing requested patterns accidentally."
DIMENSIONS = ("narrative_completeness", "coherence", "decodability_adherence", "target_phonics_pattern_emphasis", "overall_spec_adherence")
STORY_DIMENSIONS = ("spec_adherence", "robustness", "task_quality")
