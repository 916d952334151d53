"""SQL of the queries that SQL can express."""

from markloom.llm import collocations


def _collocations(most: int = collocations.MOST_WORDS, least: int = collocations.LEAST_COUNT, top: int = 2000) -> str:
    return rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM lists, (SELECT unnest(range(1, {most + 1})) AS k)),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
sizes AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
several AS (SELECT * FROM counts WHERE k > 1 AND f >= {least}),
kept AS (
  SELECT * FROM several s WHERE NOT EXISTS (
    SELECT 1 FROM several t WHERE t.lang = s.lang AND t.k > s.k AND 100 * t.f >= 100 * s.f
      AND contains(' ' || t.phrase || ' ', ' ' || s.phrase || ' '))),
cuts AS (
  SELECT lang, phrase, f AS a, k AS size, unnest(range(1, k)) AS cut, string_split(phrase, ' ') AS w FROM kept),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, n, ((1000::HUGEINT * c.a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN sizes USING (lang)
  JOIN counts x ON x.lang = c.lang AND x.k = c.cut AND x.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN counts y ON y.lang = c.lang AND y.k = c.size - c.cut AND y.phrase = array_to_string(c.w[c.cut + 1:], ' ')),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM worst QUALIFY rank <= {top}"""


ORACLES: dict[str, str] = {"op11_collocations": _collocations()}
