"""Fixed values of the judge's rubric: scores are comparable only under the same wording, so it stands here as it is."""

from __future__ import annotations

# fixed values: what a story should be, the order of patterns, and what a judge must not reward
BEHAVIOR = """Given 1–3 target phonics focuses, the model generates a decodable story that
adheres to the requested phonics level and forms a complete narrative with a
clear beginning, middle, and end. The model minimizes phonics patterns above
the requested decodability level, avoids unnecessary out-of-scope vocabulary,
and does not produce incomplete or incoherent stories."""
HIERARCHY = """Phonics progression (lower = more basic; higher = more advanced):
1. short-vowel words
2. consonant blends and consonant digraphs
3. final-e words
4. vowel teams
5. r-controlled vowels
6. diphthongs
7. multisyllabic words

The permitted ceiling for a story is the highest requested target pattern.
Vocabulary or spelling patterns above that ceiling should lower the
decodability-adherence score. Target-phonics emphasis is separate: a story can
stay within level yet still fail to practice the requested patterns enough."""
PRIORITIES = """Before scoring, remember:
- Evaluate the story only against the behavior specification.
- Do NOT reward advanced vocabulary.
- Do NOT reward literary sophistication.
- Do NOT reward longer stories.
- Do NOT reward more descriptive writing.
- Judge whether the story would function as an appropriate decodable reading
  passage for the requested phonics progression.

Score each dimension independently. Avoid double-counting the same issue across
dimensions when possible (e.g., above-level vocabulary belongs under
decodability adherence, not coherence or completeness)."""
STORY_BEHAVIOR = """Behavior specification (priority order):
1. MOST IMPORTANT: Produce a decodable story students at the requested phonics
   progression can read and learn from. Minimize above-level vocabulary/patterns.
2. Emphasize the requested phonics patterns enough to be useful practice, without
   sacrificing decodability.
3. Include a natural title; form a coherent beginning/middle/end; do not mention
   phonics terms or pattern names.

Do NOT reward advanced vocabulary, sophistication, or longer stories.
An advanced story that happens to contain the target patterns is NOT on-spec if
students at the requested level could not decode it."""

# fixed values: what 0, 1 and 2 mean in each dimension
SCALES = {
    "narrative_completeness": "Score only whether the story has a beginning, middle, and ending. 0 = incomplete or obviously cut off; 1 = mostly complete but weak transitions or ending; 2 = clear beginning, middle, and ending. Do not reward length or complexity.",
    "coherence": "Judge whether the story is understandable and internally consistent. 0 = confusing or contradictory; 1 = mostly coherent with minor issues; 2 = easy to follow and internally consistent. Do not reward literary quality or creativity.",
    "decodability_adherence": "Judge whether the vocabulary stays within the requested phonics progression. 0 = frequent unnecessary vocabulary or spelling patterns above the requested progression; 1 = mostly appropriate but contains noticeable unnecessary above-level vocabulary; 2 = vocabulary overwhelmingly stays within the requested progression with only occasional unavoidable exceptions.",
    "target_phonics_pattern_emphasis": "Judge whether the requested phonics patterns are practiced throughout the story. 0 = requested patterns are rarely present; 1 = requested patterns appear several times; 2 = requested patterns are naturally repeated throughout the story. Do not require every sentence to contain the target pattern.",
    "overall_spec_adherence": "Considering all of the above, how well does the story satisfy the complete behavior specification? 0 = poor adherence; 1 = partial adherence; 2 = strong adherence.",
    "spec_adherence": "PRIMARY: Does this story work as a decodable text that students at the requested phonics level can actually read and learn from? The most important requirement is staying within the permitted phonics progression so the passage is readable for that learner. Secondary: natural title, complete enough narrative, no phonics metalanguage. Do NOT penalize mainly for missing some target-pattern repetitions if the text is appropriately decodable. Do NOT reward advanced vocabulary, literary style, or length. 0 = not usable as decodable student text (too hard / off-level / unreadable for the requested level); 1 = partly usable but noticeable above-level vocabulary or other spec issues; 2 = clearly usable decodable practice text for the requested level.",
    "robustness": "How stable/usable is this story as instructional decodable text? Penalize truncation, repetition loops, gibberish, contradictory plot, or formatting collapse. 0 = unusable / broken; 1 = mostly usable with clear defects; 2 = clean, reliable instructional text. Do not reward length.",
    "task_quality": "Given that the text is meant for students to read and learn from: how effective is it as practice at this level? Prefer clear, child-readable decodable prose that also gives some useful practice of the requested patterns. Coverage helps, but readability at level matters more than stuffing in every pattern. 0 = poor learning text; 1 = mixed; 2 = strong student-facing practice text.",
    "consistency": "0 = highly inconsistent (decodability/readability for the level swings wildly); 1 = mixed consistency; 2 = consistently usable as in-level decodable student text across generations.",
}
