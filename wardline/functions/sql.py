"""Functions for Spark SQL: scalar ones and row-makers for LATERAL, with SQL bodies that Catalyst takes in.

register() makes them temporary functions of a session, under the names of the column
functions whose results they give:

    SELECT * FROM cells, LATERAL house_ranges(cell)
    SELECT * FROM statutes, LATERAL statute_rules(said)
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import text

_SPAN = r"(\\d+)\\s*[-–—]\\s*(\\d+)"

SCALARS = {
    "ru_lower(s STRING) RETURNS STRING": "translate(lower(coalesce(s, '')), 'ё', 'е')",
    "ru_stem(s STRING) RETURNS STRING": rf"regexp_replace(ru_lower(s), '^(\\p{{L}}{{3,}}?)(?:{'|'.join(text.ENDINGS)})$', '$1')",
    "house_parity(s STRING) RETURNS STRING": "CASE WHEN contains(lower(s), 'нечет') OR contains(lower(s), 'нечёт') THEN 'odd' WHEN contains(lower(s), 'чет') OR contains(lower(s), 'чёт') THEN 'even' END",
}

HOUSE_RANGES = rf"""house_ranges(cell STRING) RETURNS TABLE (house_from INT, house_to INT, house_parity STRING, house_step INT)
RETURN SELECT r.house_from, r.house_to, r.house_parity, r.house_step FROM (
  SELECT explode(concat(
    transform(spans, x -> named_struct('house_from', try_cast(regexp_extract(x, '^(\\d+)', 1) AS INT), 'house_to', try_cast(regexp_extract(x, '(\\d+)$', 1) AS INT), 'house_parity', p, 'house_step', IF(p IS NULL, NULL, 2))),
    IF(size(numbers) > 2 AND forall(sequence(1, greatest(size(numbers) - 1, 1)), i -> coalesce(get(numbers, i) - get(numbers, i - 1) = 2, false)),
      array(named_struct('house_from', array_min(numbers), 'house_to', array_max(numbers), 'house_parity', IF(array_min(numbers) % 2 = 0, 'even', 'odd'), 'house_step', 2)),
      transform(numbers, n -> named_struct('house_from', n, 'house_to', n, 'house_parity', CAST(NULL AS STRING), 'house_step', CAST(NULL AS INT)))))) AS r
  FROM (SELECT house_parity(cell) AS p, regexp_extract_all(cell, '{_SPAN}', 0) AS spans,
    array_sort(array_distinct(transform(regexp_extract_all(regexp_replace(cell, '{_SPAN}', ' '), '(\\d+)', 1), x -> try_cast(x AS INT)))) AS numbers))"""

STATUTE_RULES = r"""statute_rules(said STRING) RETURNS TABLE (pos INT, street STRING, house_from INT, house_to INT, house_parity STRING, house_step INT, house_suffix STRING)
RETURN SELECT pos, street, array_min(numbers), array_max(numbers), p, IF(p IS NULL, NULL, 2), IF(size(suffixes) = 1, get(suffixes, 0), NULL) FROM (
  SELECT pos, rule.street, house_parity(rule.piece) AS p, transform(regexp_extract_all(rule.piece, '(\\d+)', 1), x -> try_cast(x AS INT)) AS numbers,
    array_distinct(filter(regexp_extract_all(lower(rule.piece), '(?U)\\d+([а-яёa-z])(?!\\w)', 1), x -> x != '')) AS suffixes
  FROM (SELECT posexplode(filter(transform(split(regexp_replace(regexp_replace(said, '(?iu)улицы\\s*:', '. '), '(?iu)\\bул\\.\\s*', 'улица '), '[.;](?=\\s|$)'),
    x -> named_struct('piece', trim(x), 'street', nullif(trim(regexp_extract(trim(x), '(?iu)^(?:ул(?:ица|\\.)?\\s+)?([А-Яа-яЁёA-Za-z][А-Яа-яЁёA-Za-z\\s\\-]+?)\\s*(?:,|:|\\(|дома|д\\.|№|\\d|$)', 1)), ''))),
    r -> r.street IS NOT NULL)) AS (pos, rule)))"""


def register(spark: SparkSession) -> None:
    """Make the functions of this module temporary functions of the session."""
    for head, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    for made in (HOUSE_RANGES, STATUTE_RULES):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {made}")
