"""Building blocks of the DuckDB oracles: expressions and common table expressions, written apart from the DataFrame code."""

from __future__ import annotations

from storyscale.functions.lexicon import (
    DIGRAPHS,
    DISPLAY,
    FINAL_BLENDS,
    FINAL_E_EXCEPTIONS,
    INITIAL_BLENDS,
    IRREGULAR_WORDS,
    LEAKAGE_TERMS,
    MID_PHRASE,
    OW_LONG_O,
    PATTERNS,
    STAGES,
    TARGET_LISTS,
    TRAILERS,
    VOWEL_TEAMS,
)


def text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def texts(xs) -> str:
    return ", ".join(map(text, xs))


def rounded(x: str, digits: int = 4) -> str:
    """Half-even decimal rounding of the exact binary value of a double."""
    m = f"{10.0**digits}::double"
    a = f"abs(({x})::double)"
    c = f"({a} * 134217729::double)"
    h = f"({c} - ({c} - {a}))"
    p = f"({a} * {m})"
    e = f"(({h} * {m} - {p}) + ({a} - {h}) * {m})"
    f = f"floor({p})"
    d = f"({p} - {f} - 0.5::double)"
    return f"(sign(({x})::double) * (CASE WHEN {d} = 0 AND {e} < 0 THEN {f} WHEN {d} > 0 OR ({d} = 0 AND ({e} > 0 OR ({e} = 0 AND {f} % 2 = 1))) THEN {f} + 1 ELSE {f} END) / {m})"


def mean(x: str) -> str:
    return f"coalesce(sum(CAST({x} AS DECIMAL(18,4)))::double / count({x}), 0::double)"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def normal_word(w: str) -> str:
    w = f"replace(lower({w}), '’', '''')"
    return f"CASE WHEN suffix({w}, '''s') AND length({w}) > 2 THEN left({w}, length({w}) - 2) WHEN suffix({w}, 'n''t') AND length({w}) > 3 THEN left({w}, length({w}) - 3) ELSE split_part({w}, '''', 1) END"


WORDS = "regexp_extract_all({}, '[A-Za-z]+(?:[''’][A-Za-z]+)?')"

STORIES = f"""stories AS MATERIALIZED (SELECT doc_id AS row_ord, CASE WHEN ((doc_id * 7919) % 1009) % 2 = 0 THEN 'base' ELSE 'tuned' END AS model, source AS prompt_id,
  CAST(doc_id // 40 AS VARCHAR) AS generation_id, CAST(doc_id // 40 + 1000 AS VARCHAR) AS seed,
  ([{texts(TARGET_LISTS)}])[CAST(substr(source, 4) AS INT) % {len(TARGET_LISTS)} + 1] AS target_phonics, text AS story FROM documents)"""

TOKENS = f"""tokens AS MATERIALIZED (SELECT row_ord, {normal_word('w')} AS word FROM (SELECT row_ord, unnest({WORDS.format('story')}) AS w FROM stories)),
counted AS MATERIALIZED (SELECT row_ord, word, CAST(count(*) AS INT) AS freq FROM tokens GROUP BY ALL)"""


def syllables(w: str) -> str:
    n = f"len(regexp_extract_all({w}, '[aeiouy]+'))"
    return f"CASE WHEN length({w}) <= 3 THEN 1 ELSE greatest(1, {n} - CASE WHEN suffix({w}, 'e') AND NOT suffix({w}, 'le') AND NOT suffix({w}, 'ye') AND {n} > 1 THEN 1 ELSE 0 END + CASE WHEN regexp_matches({w}, '[^aeiouy]le$') THEN 1 ELSE 0 END) END"


def magic_e(w: str) -> str:
    return f"({w} NOT IN ({texts(FINAL_E_EXCEPTIONS)}) AND length({w}) >= 4 AND regexp_matches({w}, '[aeiou][^aeiou]e$'))"


def flags(w: str, syl: str = "syl") -> dict[str, str]:
    """A condition for each pattern."""
    reg = f"{w} NOT IN ({texts(IRREGULAR_WORDS)})"
    some = lambda xs: "(" + " OR ".join(f"contains({w}, {text(x)})" for x in xs) + ")"
    return {
        "digraph": f"{reg} AND {some(DIGRAPHS)}",
        "blend": f"{reg} AND ({' OR '.join([f'prefix({w}, {text(x)})' for x in INITIAL_BLENDS] + [f'suffix({w}, {text(x)})' for x in FINAL_BLENDS])})",
        "final_e": f"{reg} AND {magic_e(w)}",
        "vowel_team": f"{reg} AND {some(VOWEL_TEAMS)}",
        "r_controlled": f"{reg} AND {some(['ar', 'er', 'ir', 'or', 'ur'])}",
        "l_controlled": f"{reg} AND {some(['al'])}",
        "diphthong": f"{reg} AND ({some(['oi', 'oy', 'ou', 'au', 'aw'])} OR (contains({w}, 'ow') AND {w} NOT IN ({texts(OW_LONG_O)})))",
        "multisyllabic": f"{syl} >= 2",
        "irregular": f"NOT ({reg})",
    }


def classify(source: str, syl: str | None = None) -> str:
    """SELECT of a relation with a column word: syllables and a boolean p_<pattern> for each pattern."""
    given = syl or syllables("word")
    cols = ", ".join(f"({c}) AS p_{p}" for p, c in flags("word").items())
    return f"SELECT *, {cols} FROM (SELECT *, {given} AS syl FROM {source})"


_REST = "NOT (" + " OR ".join(f"p_{p}" for p in PATTERNS) + ")"
STAGE = "CASE " + " ".join(f"WHEN {' OR '.join(f'p_{p}' for p in PATTERNS if STAGES[p] == s)} THEN {s}" for s in sorted(set(STAGES.values()), reverse=True) if s > 1) + " WHEN p_irregular THEN 0 ELSE 1 END"
PATTERN_LIST = "list_filter([" + ", ".join(f"CASE WHEN {_REST if p == 'basic_or_unclassified' else 'p_' + p} THEN '{p}' END" for p in sorted([*PATTERNS, "irregular", "basic_or_unclassified"])) + "], lambda x: x IS NOT NULL)"
NOTES = f"""list_filter([CASE WHEN {' + '.join(f'p_{p}::int' for p in PATTERNS)} >= 2 THEN 'contains multiple target patterns' END, CASE WHEN word IN ({texts(FINAL_E_EXCEPTIONS)}) THEN 'final-e spelling exception' END,
  'not found in CMU pronunciation dictionary', CASE WHEN NOT p_irregular AND word IN ({texts(OW_LONG_O)}) THEN 'ow may represent long-o' END], lambda x: x IS NOT NULL)"""

CLASSIFIED = f"""classified AS MATERIALIZED ({classify('(SELECT word, CAST(sum(freq) AS BIGINT) AS total FROM counted GROUP BY word)')}),
staged AS MATERIALIZED (SELECT c.row_ord, c.freq, k.*, {STAGE} AS stage FROM counted c JOIN classified k USING (word))"""


def targets(x: str) -> str:
    return f"list_filter(list_transform(string_split(coalesce({x}, ''), ','), lambda t: {strip('t')}), lambda t: t <> '')"


_STAGE_OF = "CASE {} " + " ".join(f"WHEN {text(d)} THEN {STAGES[p]}" for p, d in DISPLAY.items()) + " END"


def ceiling(ts: str) -> str:
    return f"coalesce(list_max(list_transform({ts}, lambda t: {_STAGE_OF.format('t')})), 0)"


def ceiling_label(ts: str, top: str) -> str:
    return "CASE " + " ".join(f"WHEN {top} = {STAGES[p]} AND list_contains({ts}, {text(d)}) THEN {text(d)}" for p, d in DISPLAY.items()) + " ELSE '' END"


LEVELS = f"""aimed AS MATERIALIZED (SELECT *, {ceiling('targets')} AS permitted_ceiling_stage FROM (SELECT row_ord, target_phonics, {targets('target_phonics')} AS targets FROM stories)),
per_word AS (SELECT s.*, a.permitted_ceiling_stage AS top, a.permitted_ceiling_stage > 0 AND s.stage > a.permitted_ceiling_stage AS above FROM staged s JOIN aimed a USING (row_ord)),
sums AS MATERIALIZED (SELECT row_ord, CAST(sum(freq) AS INT) AS word_count, CAST(count(*) AS INT) AS unique_word_count, CAST(coalesce(sum(freq) FILTER (above), 0) AS INT) AS n_above, CAST(count(*) FILTER (above) AS INT) AS d_above,
  CAST(coalesce(sum((stage - top) * freq) FILTER (above), 0) AS INT) AS distance, CAST(coalesce(max(stage - top) FILTER (above), 0) AS INT) AS max_distance, coalesce(string_agg(word, ', ' ORDER BY word) FILTER (above), '') AS above_words,
  {', '.join(f"CAST(count(*) FILTER ({'NOT p_irregular AND ' + _REST if p == 'short_vowel' else 'p_' + p}) AS INT) AS n_{p}" for p in DISPLAY)} FROM per_word GROUP BY row_ord),
rates AS MATERIALIZED (SELECT a.row_ord, a.targets, a.permitted_ceiling_stage, coalesce(word_count, 0) AS word_count, coalesce(unique_word_count, 0) AS unique_word_count, coalesce(n_above, 0) AS n_above, coalesce(d_above, 0) AS d_above,
  coalesce(max_distance, 0) AS max_distance, coalesce(above_words, '') AS above_words, coalesce(n_above::double / word_count, 0) AS above, coalesce(d_above::double / unique_word_count, 0) AS distinct_above,
  coalesce((word_count - n_above)::double / word_count, 0) AS below, CASE WHEN coalesce(n_above, 0) = 0 THEN 0::double ELSE distance::double / n_above END AS mean_distance, coalesce(distance::double / word_count, 0) AS weighted,
  list_transform(a.targets, lambda t: coalesce(CASE t {' '.join(f'WHEN {text(d)} THEN n_{p}' for p, d in DISPLAY.items())} END, 0)) AS counts, {', '.join(f'coalesce(n_{p}, 0) AS {p}_distinct_count' for p in DISPLAY)}
  FROM aimed a LEFT JOIN sums USING (row_ord)),
levels AS MATERIALIZED (SELECT row_ord, targets, counts, permitted_ceiling_stage, word_count, unique_word_count, above_words AS above_level_words, n_above AS above_level_word_occurrences, d_above AS above_level_distinct_words, max_distance AS max_above_level_distance,
  {rounded('above')} AS above_level_rate, {rounded('distinct_above')} AS distinct_above_level_rate, {rounded('1::double - above')} AS decodability_compliance, {rounded('1::double - distinct_above')} AS distinct_decodability_compliance,
  {rounded('below')} AS on_or_below_level_rate, {rounded('mean_distance')} AS mean_above_level_distance, {rounded('weighted')} AS weighted_above_level_rate,
  {rounded("CASE WHEN len(targets) = 0 THEN 0::double ELSE list_sum(list_transform(counts, lambda n: least(n::double / 4, 1::double))) / len(targets) END")} AS target_satisfaction_rate, {', '.join(f'{p}_distinct_count' for p in DISPLAY)} FROM rates)"""




def title_ctes(source: str, key: str) -> str:
    """CTEs lined and titled over ``source`` (key, story): title_text is null where there is no title."""
    nl = "chr(10)"
    return rf"""lined AS (SELECT {key}, story, lines, {strip('coalesce(lines[1], chr(32))')} AS l1, {strip('coalesce(lines[2], chr(32))')} AS l2, {strip('coalesce(lines[3], chr(32))')} AS l3, len(lines) AS n_lines FROM
  (SELECT {key}, story, string_split(regexp_replace(regexp_replace(coalesce(story, ''), '\r\n?', {nl}, 'g'), '^([^\S\n]*\n)+', ''), {nl}) AS lines FROM {source})),
titled AS MATERIALIZED (SELECT {key}, story, CASE WHEN regexp_matches(l1, '^\s*\*\*(.+?)\*\*\s*$') THEN {strip("regexp_extract(l1, '^\\s*\\*\\*(.+?)\\*\\*\\s*$', 1)")}
  WHEN regexp_matches(l1, '^\s{{0,3}}#{{1,6}}\s+\S+') THEN {strip("regexp_replace(l1, '^\\s{0,3}#{1,6}\\s*', '')")}
  WHEN regexp_matches(l1, '(?i)^\s*(?:title\s*[:\-–—]\s*)+') THEN {strip("regexp_replace(" + strip("regexp_replace(l1, '(?i)^\\s*(?:title\\s*[:\\-–—]\\s*)+', '')") + ", '^\\*+|\\*+$', '', 'g')")}
  WHEN n_lines >= 3 AND l1 <> '' AND l2 = '' AND l3 <> '' AND len(regexp_split_to_array(l1, '\s+')) <= 12 AND NOT right(l1, 1) IN ('.', '?', '!') THEN l1 END AS title_text FROM lined),
bodied AS MATERIALIZED (SELECT *, CASE WHEN coalesce(title_text, '') = '' THEN whole ELSE {strip("regexp_replace(whole, '^[^\\n]*\\n?', '')")} END AS body FROM (SELECT *, {strip("regexp_replace(coalesce(story, ''), '\\r\\n?', chr(10), 'g')")} AS whole FROM titled)),
parted AS MATERIALIZED (SELECT *, list_filter(list_transform(regexp_split_to_array(regexp_replace(body, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda s: {strip('s')}), lambda s: regexp_matches(s, '[A-Za-z]')) AS parts FROM bodied),
normed AS MATERIALIZED (SELECT *, list_filter(list_transform(parts, lambda s: regexp_replace(regexp_replace({strip('lower(s)')}, '\s+', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s]', '', 'g')), lambda s: s <> '') AS norms FROM parted),
repeats AS MATERIALIZED (SELECT {key}, list(s ORDER BY s) AS repeated FROM (SELECT {key}, s FROM (SELECT {key}, unnest(norms) AS s FROM normed) GROUP BY ALL HAVING count(*) > 1) GROUP BY {key}),
checked AS MATERIALIZED (SELECT n.*, coalesce(r.repeated, []) AS repeated, {leakage('story')} AS leaks, {incomplete()} AS reasons FROM normed n LEFT JOIN repeats r USING ({key}))"""


def leakage(x: str) -> str:
    return f"array_to_string(list_filter([{texts(sorted(LEAKAGE_TERMS))}], lambda t: contains(lower(coalesce({x}, '')), t)), ', ')"


def incomplete() -> str:
    raw = strip("coalesce(story, '')")
    end = f"(CASE WHEN body <> '' THEN body ELSE {raw} END)"
    parts = [
        "CASE WHEN body = '' THEN 'title_only_or_empty_body' END",
        r"CASE WHEN len(parts) <= 1 AND (CASE WHEN body = '' THEN 0 ELSE len(regexp_split_to_array(body, '\s+')) END) < 20 THEN 'too_short' END",
        f"CASE WHEN {' OR '.join(f'suffix({end}, {text(t)})' for t in TRAILERS)} THEN 'bad_ending_punctuation' END",
        rf"CASE WHEN regexp_matches({end}, '(?i)\b({'|'.join(MID_PHRASE)})\s*$') THEN 'ends_mid_phrase' END",
        f"CASE WHEN regexp_matches({end}, '[A-Za-z]$') THEN 'no_terminal_punctuation' END",
        f"CASE WHEN (length({raw}) - length(replace({raw}, '\"', ''))) % 2 = 1 THEN 'unbalanced_quotes' END",
    ]
    return f"CASE WHEN {raw} = '' THEN 'empty_story' ELSE array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL), ',') END"


OBJECTIVE = f"""{title_ctes('stories', 'row_ord')},
objective AS MATERIALIZED (SELECT s.row_ord, s.model, s.prompt_id, s.generation_id, s.seed, s.target_phonics, s.story, l.decodability_compliance, l.distinct_decodability_compliance, l.weighted_above_level_rate, l.mean_above_level_distance,
  l.target_satisfaction_rate, l.target_satisfaction_rate AS target_phonics_coverage, CAST(c.leaks <> '' AS INT) AS phonics_leakage_rate, CAST(c.title_text IS NOT NULL AS INT) AS title_rate, l.word_count, l.above_level_rate, l.above_level_rate AS off_target_phonics_rate,
  l.decodability_compliance AS on_level_rate, CAST(c.title_text IS NOT NULL AS INT) AS title_present, CAST(c.leaks = '' AS INT) AS no_phonics_leakage, CAST(c.leaks <> '' AS INT) AS phonics_leakage, CAST(len(c.parts) AS INT) AS sentence_count,
  CAST(len(c.repeated) = 0 AS INT) AS no_duplicate_sentences, CAST(len(c.repeated) > 0 AS INT) AS has_duplicate_sentences, CAST(c.reasons = '' AS INT) AS complete_output, CAST(c.reasons <> '' AS INT) AS incomplete_output,
  coalesce(c.title_text, '') AS detected_title, array_to_string(c.repeated[1:5], ' | ') AS duplicate_sentence_norms, c.reasons AS incomplete_reasons, c.leaks AS phonics_leakage_terms, l.above_level_words, l.permitted_ceiling_stage
  FROM stories s JOIN levels l USING (row_ord) JOIN checked c USING (row_ord))"""

JUDGED = """judge AS MATERIALIZED (SELECT doc_id AS row_ord, quality + 1 - toxic AS spec_adherence_score, 2 * quality AS task_quality_score, 2 - toxic - (1 - quality) AS robustness_score, quality + (1 - toxic) AS overall_spec_adherence_score,
  2 * quality * (1 - toxic) AS decodability_adherence_score, (doc_id % 3) * quality AS target_phonics_pattern_emphasis_score, 2 - 2 * toxic AS coherence_score, 1 + quality AS narrative_completeness_score FROM labels)"""


def query(select: str, *ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select if ctes else select


TO_STAGED = (STORIES, TOKENS, CLASSIFIED)
TO_LEVELS = (*TO_STAGED, LEVELS)
TO_OBJECTIVE = (*TO_LEVELS, OBJECTIVE)
TO_JUDGED = (*TO_OBJECTIVE, JUDGED)
