"""Text cut off by field limits, from word trigrams in SQL only (p3).

Texts are read line by line, each line as words with two marks before its first one. A trigram is two words of context, by their
class (keyword or sign itself, name, number), and a word. All trigrams of all texts and prompts are counted: equal lines are counted first,
so that only distinct lines are split into words. The final trigram of each text is then compared with them: how often it stands
inside texts, also as the beginning of a longer word (``va`` of ``varchar``), and how many other texts end with it. A final
trigram that is frequent inside (``LEAST``) and almost never terminal (``TERMINAL_SHARE``) flags its text; where the word is
too rare to tell, its class stands for it (a name that nobody else typed, right after ``REL``).

An exact check of the flagged texts' last line follows: complete statements, columns of an unusual but whole model, text copied
from the prompt to the end of its line, closed prose. Two other signs need no trigram, for they are said outright: a mark of the
cut that was appended, and a code fence left open. ``judged_texts`` tells the path of every text.

Ends are counted in distinct texts (by digest) other than the text's own, so copies of a cut answer don't make its end look usual.
Finish reasons and token counts aren't read: they decide nothing here, and the rates per source compare them.

Defined results: null, blank and word-less texts aren't cut, nor is a text of one word; a mark of a cut after any word is a cut;
repeated rows of a run count once; a run is cut if any of its rows is. Texts of any length are read whole. Only the named columns
are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from sondage.session import checked_broadcast, checkpoint, spread

#: A final trigram that stands inside texts so often at least can be judged by itself, and by its word's class otherwise.
LEAST = 2
#: Trigrams of which less than this share ends other texts are almost never terminal.
TERMINAL_SHARE = 0.02
#: Prose without a closing mark counts as complete if its final trigram ends this share of its occurrences, in two texts or more.
PROSE_SHARE = 0.2

# Tests of the last character come first, for they cost nothing.
TEXTS = r"""
SELECT run_id, provider, prompt_file, mark != '' AS marked, CASE WHEN mark = '' THEN text ELSE trim(TRAILING ' \t\n\r\f' FROM left(text, length(text) - length(mark))) END AS body FROM (
  SELECT *, CASE WHEN endswith(text, ']') OR endswith(text, ')') OR endswith(text, '>') OR endswith(text, '…') OR endswith(text, '...')
    THEN regexp_extract(text, '(?:\\[\\s*(?:cut|truncated|\\.\\.\\.|…)\\s*\\]|\\((?:cut|truncated)\\)|<(?:cut|truncated)>|…|\\.\\.\\.)$', 0) ELSE '' END AS mark
  FROM (SELECT run_id, provider, prompt_file, CASE WHEN endswith(text, ' ') OR endswith(text, '\n') OR endswith(text, '\r') OR endswith(text, '\t') OR endswith(text, '\f') THEN trim(TRAILING ' \t\n\r\f' FROM text) ELSE text END AS text
        FROM {raw} WHERE text RLIKE '[^ \t\n\r\f]'))
"""

# A line without list marker and emphasis, in lower case; its words, which are runs of ASCII letters and digits and of all beyond ASCII, other characters alone; their classes.
PLAIN = r"regexp_replace(regexp_replace(regexp_replace(LINE, '→|⇒|⟶|➔', '->'), '\\*\\*|__', ''), '^[\\s>]*(?:[-*•+–]+(?:\\s+|$)|[0-9]+[.)](?:\\s+|$))?', '')"
WORDS = r"regexp_extract_all(lower(TEXT), '[a-z0-9_\\x80-\\x{{10ffff}}]++|->|\\S', 0)"
CLASS = r"CASE WHEN WORD IN ('entity', 'pk', 'attr', 'rel', 'fk') OR NOT WORD RLIKE '^[a-z0-9_\\x80-\\x{{10ffff}}]' THEN WORD WHEN WORD RLIKE '^[0-9]+$' THEN '0' ELSE 'w' END"

TRIGRAMS = (
    r"""
SELECT g.a, g.b, g.c, g.k, sum(n) AS n FROM (
  SELECT n, explode(transform(sequence(0, size(words) - 3), i -> struct(kinds[i] AS a, kinds[i + 1] AS b, words[i + 2] AS c, kinds[i + 2] AS k))) AS g FROM (
    SELECT n, words, transform(words, x -> CLASS) AS kinds FROM (
      SELECT n, concat(array('^', '^'), WORDS) AS words FROM (
        SELECT line, count(*) AS n FROM (SELECT explode(split(replace(body, '\r', '\n'), '\n')) AS line FROM (SELECT text AS body FROM {raw} UNION ALL SELECT prompt_text FROM {prompts})) WHERE line != '' GROUP BY line)))
  WHERE size(words) > 2)
GROUP BY g.a, g.b, g.c, g.k
"""
).replace("WORDS", WORDS.replace("TEXT", PLAIN.replace("LINE", "line"))).replace("CLASS", CLASS.replace("WORD", "x"))

# Every text with its last line and final trigram. None of its three words is null, else the join would have the scan test them for null and compute them twice.
ENDS = (
    r"""
SELECT *, coalesce(CASE WHEN size(words) > 2 THEN KIND_A END, '^') AS a, coalesce(CASE WHEN size(words) > 1 THEN KIND_B END, '^') AS b, coalesce(get(words, size(words) - 1), '') AS c, KIND_C AS k FROM (
  SELECT *, WORDS AS words FROM (
    SELECT *, PLAIN AS line FROM (SELECT *, substring_index(replace(body, '\r', '\n'), '\n', -1) AS last_line FROM {texts})))
"""
).replace("WORDS", WORDS.replace("TEXT", "line")).replace("PLAIN", PLAIN.replace("LINE", "last_line"))
for _name, _word in (("KIND_A", "get(words, size(words) - 3)"), ("KIND_B", "get(words, size(words) - 2)"), ("KIND_C", "coalesce(get(words, size(words) - 1), '')")):
    ENDS = ENDS.replace(_name, CLASS.replace("WORD", _word))

FINALS = "SELECT a, b, c, any_value(k) AS k, count(DISTINCT xxhash64(body)) AS ends, count(*) AS rows FROM {ends} GROUP BY a, b, c"

# What the final trigrams do inside texts: whole, as the beginning of a longer word (only the lengths of final words are looked up, so long words cost no more), and by their word's class.
JUDGED = """
SELECT f.a, f.b, f.c, f.ends, greatest(0, coalesce(i.whole, 0) - f.rows) AS inside, coalesce(i.n, 0) - coalesce(i.whole, 0) AS longer,
  CASE WHEN coalesce(i.n, 0) - f.rows >= {least} THEN f.ends - 1 < {share} * (f.ends - 1 + i.n - f.rows)
       ELSE coalesce(c.n, 0) - d.rows >= {least} AND d.ends - 1 < {share} * (d.ends - 1 + c.n - d.rows) END AS unended
FROM {finals} f
LEFT JOIN (SELECT t.a, t.b, left(t.c, l.size) AS c, sum(t.n) AS n, sum(CASE WHEN length(t.c) = l.size THEN t.n ELSE 0 END) AS whole
           FROM {trigrams} t JOIN {sizes} l ON t.a = l.a AND t.b = l.b AND l.size <= length(t.c) GROUP BY t.a, t.b, left(t.c, l.size)) i
  ON f.a = i.a AND f.b = i.b AND f.c = i.c
JOIN (SELECT a, b, k, sum(ends) AS ends, sum(rows) AS rows FROM {finals} GROUP BY a, b, k) d ON f.a = d.a AND f.b = d.b AND f.k = d.k
LEFT JOIN (SELECT a, b, k, sum(n) AS n FROM {trigrams} GROUP BY a, b, k) c ON f.a = c.a AND f.b = c.b AND f.k = c.k
"""

CANDIDATES = r"""
SELECT e.run_id, e.provider, e.prompt_file, e.body, e.last_line, e.line, e.c, e.marked, j.ends, j.inside, j.longer, j.unended,
  (instr(e.body, '```') > 0 OR instr(e.body, '~~~') > 0) AND size(regexp_extract_all(e.body, '(?m)^[ \\t>]*(?:```|~~~)', 0)) % 2 = 1 AS open_fence
FROM {ends} e JOIN {judged} j ON e.a = j.a AND e.b = j.b AND e.c = j.c
WHERE e.marked OR j.unended OR instr(e.body, '```') > 0 OR instr(e.body, '~~~') > 0
"""

CARDINALITY = r"(?:[01]\\.\\.(?:1|N|M|\\*)|1|N|M|\\*|MANY|ONE)"
LINES = (
    r"""
SELECT *, regexp_extract(upper(line), '^(ENTITY|PK|ATTR|REL)(?=\\s|$)', 1) AS keyword, right(body, 16) AS ending,
  CASE WHEN line RLIKE '(?i)^REL\\s.*FK\\s*=' THEN WORDS END AS words
FROM {candidates} WHERE marked OR unended OR open_fence
"""
).replace("WORDS", WORDS.replace("TEXT", "body"))

# Where the end of the text stands in its prompt, and what follows there: white space is one blank, line ends are kept in a text of equal length.
PLACED = r"""
SELECT l.*, CASE WHEN at > 0 THEN substr(prompt, at + length(tail), 1) END AS follows, at > 0 AS copied FROM (
  SELECT l.*, p.prompt, CASE WHEN length(tail) >= 12 THEN locate(tail, p.flat) ELSE 0 END AS at
  FROM (SELECT *, trim(right(regexp_replace(regexp_replace(lower(right(body, 200)), '\n[ \t]*>[ \t]?', '\n'), '\\s+', ' '), 24)) AS tail FROM {lines}) l
  LEFT JOIN (SELECT *, translate(prompt, '\n', ' ') AS flat FROM (SELECT prompt_file, regexp_replace(regexp_replace(regexp_replace(lower(prompt_text), '[ \t\r]*\n\\s*', '\n'), '[ \t\r]+', ' '), '\\s+$', '') AS prompt FROM {prompts})) p
  ON l.prompt_file = p.prompt_file) l
"""

VERDICTS = (
    r"""
SELECT run_id, provider, body, CASE WHEN unended THEN 'trigram' WHEN marked THEN 'mark' ELSE 'fence' END AS path, CASE
  WHEN NOT body RLIKE '[\\p{{L}}\\p{{N}}]' THEN false
  WHEN marked OR open_fence THEN true
  WHEN copied AND NOT ending RLIKE '[.!?)>:]$' THEN coalesce(follows, '') NOT IN ('', '\n')
  WHEN copied THEN false
  WHEN last_line RLIKE '^\\s*(?:```|~~~)\\w*\\s*$' THEN false
  WHEN last_line RLIKE '^\\s*(?:`{{1,2}}|~{{1,2}}|[-•+–*]+|[0-9]+[.)])\\s*$' THEN instr(replace(body, '\r', '\n'), '\n') > 0
  WHEN line LIKE '%<%>%' AND keyword != '' THEN false
  WHEN keyword IN ('ENTITY', 'PK') THEN true
  WHEN keyword = 'ATTR' THEN NOT line RLIKE '(?i)^ATTR\\s+[^:]*[^:\\s]\\s*:\\s*[^:\\s][^:]*(?:\\s*:\\s*(?:PK|FK))*$' OR (NOT line RLIKE '(?i):\\s*(?:PK|FK)$' AND longer > inside)
  WHEN keyword = 'REL' THEN CASE
    WHEN line RLIKE '(?i)^REL\\s+.*\\S\\s*->\\s*\\S.*?\\s*:\\s*CARD\\s*->\\s*CARD\\s*$' THEN false
    WHEN line RLIKE '(?i)^REL\\s+.*\\S\\s*->\\s*\\S.*?\\s*:\\s*CARD\\s*->\\s*CARD\\s*:\\s*FK\\s*=\\s*\\S.*$' THEN array_position(words, c) = size(words) AND (exists(words, w -> startswith(w, c) AND w != c) OR longer > inside)
    ELSE true END
  WHEN NOT body RLIKE '\\s' THEN false
  WHEN ending RLIKE '[.!?]["”»’)\\]*_]*$' THEN false
  WHEN ending RLIKE '[,;:]$' THEN true
  ELSE NOT (ends >= 2 AND longer <= inside + ends AND ends >= {prose} * (ends + inside + longer)) END AS cut
FROM {placed}
"""
).replace("CARD", CARDINALITY)


def judged_texts(raw: DataFrame, prompts: DataFrame, share: float = TERMINAL_SHARE, prose: float = PROSE_SHARE) -> DataFrame:
    """(run_id, provider, body, path, cut) of the flagged rows; the path is what flagged them: trigram, mark or fence."""
    sql = raw.sparkSession.sql
    rows = spread(raw.selectExpr("run_id", "provider", "prompt_file", "response_text AS text"))
    texts = sql(TEXTS, raw=rows)
    ends = sql(ENDS, texts=texts)
    finals = checkpoint(sql(FINALS, ends=ends))
    asked = prompts.groupBy("prompt_file").agg({"prompt_text": "min"}).withColumnRenamed("min(prompt_text)", "prompt_text")
    trigrams = checkpoint(sql(TRIGRAMS, raw=rows, prompts=asked))
    sizes = checked_broadcast(finals.selectExpr("a", "b", "length(c) AS size").distinct())
    judged = checked_broadcast(checkpoint(sql(JUDGED, finals=finals, trigrams=trigrams, sizes=sizes, least=LEAST, share=share)))
    lines = sql(LINES, candidates=sql(CANDIDATES, ends=ends, judged=judged))
    return sql(VERDICTS, placed=sql(PLACED, lines=lines, prompts=checked_broadcast(asked)), prose=prose)


def truncated_runs(raw: DataFrame, prompts: DataFrame) -> DataFrame:
    """(run_id): runs whose text was cut."""
    return judged_texts(raw, prompts).where("cut AND run_id IS NOT NULL").select("run_id").distinct()


RATES = """
SELECT r.provider, count(*) AS runs, count_if(c.run_id IS NOT NULL) AS cut_runs, count_if(r.hinted) AS hinted_runs, count_if(r.hinted AND c.run_id IS NOT NULL) AS cut_and_hinted
FROM (SELECT provider, run_id, bool_or(lower(coalesce(finish_reason, '')) IN ('length', 'max_tokens') OR coalesce(usage.output_tokens >= max_tokens, false)) AS hinted
      FROM {raw} WHERE run_id IS NOT NULL GROUP BY provider, run_id) r
LEFT JOIN {cut} c ON r.run_id = c.run_id
GROUP BY r.provider
"""


def truncation_rates(raw: DataFrame, prompts: DataFrame) -> DataFrame:
    """Per provider: runs, cut runs, runs that finish reason or token count hint at, and both."""
    return raw.sparkSession.sql(RATES, raw=raw, cut=checkpoint(truncated_runs(raw, prompts)))
