"""The query of the quality rules and its SQL, which counts, tests and chooses cutoffs in the same way."""

from __future__ import annotations

from lynceus.llm import quality_rules as q
from lynceus.llm.catalog import query, table

WORD = r"[^\x20\x09-\x0D]"


def _kept_chars(characters: str) -> str:
    return f"length(regexp_replace(text, '[^{characters}]', '', 'g'))"


_CUTS = ", ".join(f"('{rule}', {at + 1}, {cut})" for rule, (_, _, cuts) in q.RULES.items() for at, cut in enumerate(cuts))
_SHARES = ", ".join(f"{{'rule': '{rule}', 'num': {num}, 'den': {den}}}" for rule, (num, den, _) in q.RULES.items())
_SHARE = q.RISK / len(q.RULES)


@query("op12_risk_controlled_rules", rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, lang AS stratum, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, regexp_extract_all(text, '{WORD}+') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM docs),
windows AS (SELECT rid, i, words[i:i + {q.WINDOW - 1}] AS w FROM (
  SELECT rid, words, unnest(range(1, len(words) - {q.WINDOW - 2})) AS i FROM split WHERE len(words) >= {q.WINDOW})),
repeats AS (SELECT rid, count(DISTINCT pos) AS n FROM (SELECT rid, unnest(range(i, i + {q.WINDOW})) AS pos FROM (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS c FROM windows) WHERE c > 1) GROUP BY rid),
counted AS (SELECT rid, doc_id, stratum, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  {_kept_chars('#*$%&|<>')} AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
  len(lines) AS n_lines, {_kept_chars('!?')} AS n_marks, {_kept_chars('A-ZÀ-ÖØ-Þ')} AS n_upper,
  {_kept_chars('A-ZÀ-ÖØ-Þa-zß-öø-ÿ')} AS n_letters FROM split LEFT JOIN repeats USING (rid)),
based AS (SELECT *, n_words < {q.LEAST_WORDS} OR 100 * n_repeat_words > {q.MOST_REPEATED_PERCENT} * n_words AS base_failed FROM counted),
marks AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
seen AS (SELECT rid, stratum, good FROM based JOIN marks USING (doc_id) WHERE NOT base_failed),
sizes AS (SELECT stratum, count(*) FILTER (good) AS n, row_number() OVER (ORDER BY count(*) FILTER (good) DESC, stratum) AS place
  FROM seen WHERE stratum IS NOT NULL GROUP BY stratum),
doubts AS (SELECT {q.ERROR} / ((least(count(*), {q.STRATA}) + 1) * {len(q.RULES)}) AS doubt FROM sizes),
own AS (SELECT stratum FROM sizes, doubts WHERE place <= {q.STRATA} AND n >= ln(doubt) / ln(1 - {_SHARE})),
shares AS (SELECT rid, s.rule AS rule, s.num AS num, s.den AS den FROM (SELECT rid, unnest([{_SHARES}]) AS s FROM based)),
cuts AS (SELECT * FROM (VALUES {_CUTS}) t(rule, step, cut)),
placed AS (SELECT seen.rid, good, coalesce(own.stratum, '') AS stratum FROM seen LEFT JOIN own USING (stratum)),
levels AS (SELECT stratum, rule, step, cut, count(*) FILTER (good) AS n, count(*) FILTER (good AND 1000 * num > cut * den) AS lost,
  count(*) FILTER (NOT good AND 1000 * num > cut * den) AS caught
  FROM placed JOIN shares USING (rid) JOIN cuts USING (rule) GROUP BY ALL),
tested AS (SELECT *, n > 0 AND lost <= {_SHARE} * n AND CASE WHEN lost <= {_SHARE} * n THEN list_sum(list_transform(range(lost + 1),
    lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_SHARE}) + (n - i) * ln(1 - {_SHARE})))) <= doubt END AS passed
  FROM levels, doubts),
certified AS (SELECT *, bool_and(passed) OVER (PARTITION BY stratum, rule ORDER BY step) AS ok FROM tested),
chosen AS (SELECT stratum, rule, cut FROM (SELECT *, row_number() OVER (PARTITION BY stratum, rule ORDER BY caught - lost DESC, step) AS best
  FROM certified WHERE ok) WHERE best = 1 AND caught > lost),
rejected AS (SELECT DISTINCT b.rid FROM based b LEFT JOIN own USING (stratum) JOIN shares s ON s.rid = b.rid
  JOIN chosen c ON c.rule = s.rule AND c.stratum = coalesce(own.stratum, '') WHERE 1000 * num > cut * den)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND r.rid IS NULL AS kept
FROM based b LEFT JOIN rejected r USING (rid)""")
def risk_controlled_rules(spark, d):
    return q.judge(table(spark, d, "documents"), table(spark, d, "labels")).select(
        "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").withColumnRenamed("id", "doc_id")
