"""The query over phrase collocations, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import collocations


def op13_collocations(docs: DataFrame) -> DataFrame:
    return collocations.leading(collocations.collocations(docs.select("lang", "text")), 2000)


ORACLE = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
spans AS (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM w, (SELECT unnest(range(1, 5)) AS size) WHERE len(w) >= size),
f AS (SELECT lang, w[i:i + size - 1] AS p, count(*) AS f FROM spans GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, p, f AS a FROM f WHERE len(p) > 1),
cuts AS (SELECT lang, p, a, unnest(range(1, len(p))) AS k FROM c),
scored AS (SELECT cuts.lang, cuts.p, a, k, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f + y.f))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.p = cuts.p[1:k] JOIN f y ON y.lang = cuts.lang AND y.p = cuts.p[k + 1:]),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inner_parts AS (SELECT lang, a, p[i:j] AS p FROM (SELECT lang, a, p, i, unnest(range(i + 1, len(p) + 1)) AS j FROM (SELECT lang, a, p, unnest(range(1, len(p))) AS i FROM c)) WHERE j - i + 1 < len(p)),
gone AS (SELECT DISTINCT c.lang, c.p FROM c JOIN inner_parts x USING (lang, p) WHERE 100 * x.a::HUGEINT >= 80 * c.a::HUGEINT),
kept AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, score FROM best ANTI JOIN gone USING (lang, p)),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM kept JOIN totals USING (lang))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000"""
