"""The queries in SQL, stated the plain way: no shared tokenising, no regrouped sums, no hashing tricks."""

from __future__ import annotations

import math
from itertools import combinations

from raritas.catalog.tables import View
from raritas.operators.autoencoder import DRAW_DIGITS, DRAW_FACTOR, DRAW_PRIME, DRAW_STEPS, NetSpec


def _sets(d: int, arities=(1, 2, 3)) -> list[tuple[int, tuple[int, ...]]]:
    chosen = [c for r in (1, 2, 3) for c in combinations(range(d), r)]
    return [(i, c) for i, c in enumerate(chosen) if len(c) in arities]


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(str(v) for v in row) + ")" for row in rows)


# ---------------------------------------------------------------- n-grams


def grams_of(text: str, n: int) -> str:
    """List of all overlapping n-grams: the non-overlapping ones from each of the n starting places."""
    lists = [f"regexp_extract_all(substring({text}, {k}), '(?s).{{{n}}}')" for k in range(1, n + 1)]
    return "flatten([" + ", ".join(lists) + "])"


def _tokens(view: View, n: int, sets, name: str = "tokens", base: str = "base") -> str:
    texts = " UNION ALL ".join(
        f"SELECT {i} AS set_id, id, " + " || ".join(f"a{a}" for a in c) + f" AS t FROM {base}" for i, c in sets
    )
    return f"{name} AS (SELECT set_id, id, unnest({grams_of('t', n)}) AS token FROM ({texts}))"


def ngram_ctes(view: View, n: int, th: float, arities=(1, 2, 3), searched=None, tag: str = "") -> str:
    """CTEs base, tokens, freq, unusual; then parts (tokens of single attributes) and hits (token found in row)."""
    d = len(view.attrs)
    sets = _sets(d, arities)
    searched = searched or {i: c for i, c in sets}
    single = [(i, c) for i, c in _sets(d, (1,))]
    tested = _values((i, a) for i, c in sets for a in sorted(set(searched[i])))
    arity = _values((i, len(c)) for i, c in sets)
    base = f"base AS ({view.base}), " if not tag else ""
    return (
        base
        + _tokens(view, n, sets, f"tokens{tag}")
        + f""",
        freq{tag} AS (SELECT set_id, token, count(*) AS frequency FROM tokens{tag} GROUP BY set_id, token),
        averages{tag} AS (SELECT set_id, avg(frequency) AS average FROM freq{tag} GROUP BY set_id),
        unusual{tag} AS (SELECT set_id, token, frequency, average FROM freq{tag} JOIN averages{tag} USING (set_id)
            WHERE frequency < average - average * {th} OR frequency > average + average * {th}),
        arity{tag}(set_id, arity) AS (VALUES {arity}),
        tested{tag}(set_id, attr) AS (VALUES {tested}),
        """
        + _tokens(view, n, single, f"alone{tag}")
        + f""",
        parts{tag} AS (SELECT DISTINCT set_id AS attr, id, token FROM alone{tag}),
        hits{tag} AS (SELECT DISTINCT u.set_id, p.id, p.token FROM unusual{tag} u
            JOIN tested{tag} t USING (set_id) JOIN parts{tag} p ON p.attr = t.attr AND p.token = u.token)"""
    )


def ngram_tokens(view: View, n: int, n_att: int) -> str:
    d = len(view.attrs)
    sets = [(i, c) for i, c in enumerate(combinations(range(d), n_att))]
    return (
        f"WITH base AS ({view.base}), {_tokens(view, n, sets)} "
        "SELECT set_id, token, count(*) AS frequency FROM tokens GROUP BY set_id, token"
    )


def ngram_outlier_tokens(view: View, n: int, th: float) -> str:
    return f"WITH {ngram_ctes(view, n, th)} SELECT set_id, token, frequency, round(average, 6) AS average FROM unusual"


_SCORES = """SELECT b.id AS {key},
    coalesce(sum(CASE WHEN h.arity = 1 THEN 1 END), 0)::BIGINT AS single_ngram,
    coalesce(sum(CASE WHEN h.arity = 2 THEN 1 END), 0)::BIGINT AS pairs_ngram,
    coalesce(sum(CASE WHEN h.arity = 3 THEN 1 END), 0)::BIGINT AS triplets_ngram
    FROM base b LEFT JOIN allhits h ON h.id = b.id GROUP BY b.id"""


def ngram_scores(view: View, n: int, th: float, compat: bool = False) -> str:
    """WITH ... and the final SELECT of the three row scores, as one statement."""
    key = view.key
    if not compat:
        ctes = ngram_ctes(view, n, th) + ", allhits AS (SELECT id, arity FROM hits JOIN arity USING (set_id))"
    else:
        odd = {i: (c[0], c[1], c[2] - c[0]) for i, c in _sets(len(view.attrs), (3,))}
        ctes = ngram_ctes(view, n, th, (1, 2))
        union = "SELECT id, arity FROM hits JOIN arity USING (set_id)"
        if odd:
            ctes += ", " + ngram_ctes(view, 3, th, (3,), odd, "3")
            union += " UNION ALL SELECT id, arity FROM hits3 JOIN arity3 USING (set_id)"
        ctes += f", allhits AS ({union})"
    return f"WITH {ctes}, scores AS ({_SCORES.format(key=key)}) SELECT * FROM scores"


def ngram_ranked(view: View, n: int, th: float, top: float) -> str:
    inner = ngram_scores(view, n, th)
    return f"""WITH s AS (SELECT {view.key}, single_ngram + pairs_ngram + triplets_ngram AS final_score FROM ({inner}))
        SELECT {view.key}, final_score FROM s WHERE final_score >
        (SELECT {1 - top} * (max(final_score) - min(final_score)) + min(final_score) FROM s)"""


def ngram_attr_score(view: View, n: int, th: float) -> str:
    d = len(view.attrs)
    member = _values((i, a) for i, c in _sets(d) for a in c)
    every = _values((a,) for a in range(d))
    return f"""WITH {ngram_ctes(view, n, th)}, member(set_id, attr) AS (VALUES {member}), every(attr) AS (VALUES {every}),
        found AS (SELECT DISTINCT t.set_id, t.id, t.token FROM tokens t JOIN unusual u ON u.set_id = t.set_id AND u.token = t.token),
        credited AS (SELECT m.attr, count(*) AS score FROM found f JOIN member m ON m.set_id = f.set_id GROUP BY m.attr)
        SELECT every.attr AS attr, coalesce(score, 0)::BIGINT AS score FROM every LEFT JOIN credited ON every.attr = credited.attr"""


def ngram_attr_max(view: View, n: int) -> str:
    """Positions summed over every attribute, ordered pair and ordered triplet, each crediting its members."""
    d = len(view.attrs)
    lines = []
    for j in range(d):
        terms = [f"length(a{j}) - {n} + 1"]
        for a in range(d):
            for b in range(d):
                if a != b and j in (a, b):
                    terms.append(f"length(a{a} || a{b}) - {n} + 1")
                for c in range(d):
                    if len({a, b, c}) == 3 and j in (a, b, c):
                        terms.append(f"length(a{a} || a{b} || a{c}) - {n} + 1")
        total = " + ".join(f"({t})" for t in terms)
        lines.append(f"SELECT {j} AS attr, '{view.attrs[j]}' AS name, sum({total})::BIGINT AS maximum FROM base")
    return f"WITH base AS ({view.base}) " + " UNION ALL ".join(lines)


def ngram_attr_normalized(view: View, n: int, th: float) -> str:
    return f"""SELECT m.attr AS attr, m.name AS name, s.score AS score, m.maximum AS maximum,
        CASE WHEN m.maximum <> 0 THEN round(s.score / m.maximum, 9) END AS normalized_score
        FROM ({ngram_attr_max(view, n)}) m JOIN ({ngram_attr_score(view, n, th)}) s ON m.attr = s.attr"""


# ---------------------------------------------------------------- samples and LODA


def sample_cte(split: float, seed: int = 0, name: str = "smp") -> str:
    return f"""{name} AS MATERIALIZED (SELECT * FROM base QUALIFY row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR) || ':{seed}'))
        <= floor({split} * (SELECT count(*) FROM base)))"""


def loda_ctes(view: View, split: float = 0.5, contamination: float = 0.1, bins: int = 10) -> str:
    """CTEs base, smp, scored(id, set_id, attrs, score) and flag (the same with is_outlier)."""
    d = len(view.attrs)
    ranges = ", ".join(f"min(a{a}) AS lo{a}, max(a{a}) AS hi{a}" for a in range(d))
    binned = ", ".join(
        f"CASE WHEN hi{a} > lo{a} THEN CAST(least({bins - 1}, greatest(0, floor((a{a} - lo{a}) / ((hi{a} - lo{a}) / {bins})))) "
        f"AS INTEGER) ELSE 0 END AS b{a}"
        for a in range(d)
    )
    hist = " UNION ALL ".join(
        f"SELECT {a} AS attr, b{a} AS b, count(*) AS c FROM binned SEMI JOIN smp USING (id) GROUP BY b{a}" for a in range(d)
    )
    surprise = ", ".join(f"-ln(coalesce(h{a}.c / n, 1e-12)) AS s{a}" for a in range(d))
    joins = " ".join(f"LEFT JOIN hist h{a} ON h{a}.attr = {a} AND h{a}.b = b{a}" for a in range(d))
    scored = " UNION ALL ".join(
        f"SELECT id, {i} AS set_id, '{'-'.join(map(str, c))}' AS attrs, {len(c)} AS arity, "
        f"round(({' + '.join(f's{a}' for a in c)}) / {float(len(c))}, 9) AS score FROM surprise"
        for i, c in _sets(d)
    )
    return f"""base AS ({view.base}), {sample_cte(split)},
        edges AS MATERIALIZED (SELECT {ranges}, count(*) AS n FROM smp),
        binned AS MATERIALIZED (SELECT id, n, {binned} FROM base, edges),
        hist AS MATERIALIZED ({hist}),
        surprise AS MATERIALIZED (SELECT id, {surprise} FROM binned {joins}),
        scored AS MATERIALIZED ({scored}),
        thr AS MATERIALIZED (SELECT set_id, quantile_cont(score, {1 - contamination}) AS t FROM scored SEMI JOIN smp USING (id) GROUP BY set_id),
        flag AS MATERIALIZED (SELECT s.*, s.score > t.t AS is_outlier FROM scored s JOIN thr t ON s.set_id = t.set_id)"""


def loda_scores(view: View) -> str:
    return f"""WITH {loda_ctes(view)} SELECT id AS {view.key}, attrs, round(score, 6) AS score, is_outlier FROM flag"""


def loda_flags(view: View, arity: int) -> str:
    return f"WITH {loda_ctes(view)} SELECT id AS {view.key}, attrs FROM flag WHERE is_outlier AND arity = {arity}"


_WIDE = ", ".join(
    f"coalesce(string_agg(CASE WHEN arity = {r} AND is_outlier THEN attrs END, ',' ORDER BY set_id), '') AS {c}"
    for r, c in ((1, "single_loda"), (2, "pairs_loda"), (3, "triplets_loda"))
)


def loda_wide(view: View) -> str:
    return f"WITH {loda_ctes(view)} SELECT id AS {view.key}, {_WIDE} FROM flag GROUP BY id"


# ---------------------------------------------------------------- ranking and graph


def cells_ctes(view: View, flags: str | None = None) -> str:
    """Flags, by default LODA's, then cell(id, attr, v) and taken(id, attr, part, weight) for anomalous attributes."""
    d = len(view.attrs)
    member = _values((i, a, int(not (len(c) == 3 and a == c[2]))) for i, c in _sets(d) for a in c)
    cell = " UNION ALL ".join(f"SELECT id, {a} AS attr, a{a} AS v FROM base" for a in range(d))
    return f"""{flags or loda_ctes(view)}, member(set_id, attr, counted) AS (VALUES {member}), cell AS ({cell}),
        taken AS (SELECT f.id AS id, m.attr AS attr, count(*) AS part, sum(m.counted) AS weight
            FROM flag f JOIN member m ON f.set_id = m.set_id WHERE f.is_outlier GROUP BY f.id, m.attr),
        anomalous AS (SELECT t.id AS id, t.attr AS attr, c.v AS v, t.part AS part, t.weight AS weight
            FROM taken t JOIN cell c ON c.id = t.id AND c.attr = t.attr)"""


def rank_count_ctes(view: View, compat: bool = False, flags: str | None = None) -> str:
    taken = "weight" if compat else "part"
    return f"""{cells_ctes(view, flags)},
        participation AS (SELECT attr, v, sum(part) AS n FROM anomalous GROUP BY attr, v),
        ranked AS (SELECT b.id AS {view.key}, coalesce(sum(a.{taken} * p.n), 0)::BIGINT AS "Ranking_count" FROM base b
            LEFT JOIN anomalous a ON a.id = b.id LEFT JOIN participation p ON p.attr = a.attr AND p.v = a.v GROUP BY b.id)"""


def rank_count(view: View, compat: bool = False) -> str:
    return f"WITH {rank_count_ctes(view, compat)} SELECT * FROM ranked"


def value_participation(view: View) -> str:
    return f"""WITH {rank_count_ctes(view)} SELECT attr, v AS value, sum(part)::BIGINT AS in_anomalies, count(*) AS "rows"
        FROM anomalous GROUP BY attr, v"""


def _edge(name: str, th: float) -> str:
    return f'(SELECT {1 - th} * (max("{name}") - min("{name}")) + min("{name}") FROM ranked)'


def rank_cutoff(view: View, th: float) -> str:
    return f"""WITH {rank_count_ctes(view)} SELECT * FROM ranked WHERE "Ranking_count" > {_edge("Ranking_count", th)}"""


def rank_share(view: View, th: float) -> str:
    return f"""WITH {rank_count_ctes(view)}, c AS (SELECT count(*) FILTER ("Ranking_count" > {_edge("Ranking_count", th)}) AS selected,
        count(*) AS "rows" FROM ranked) SELECT selected, "rows", round(selected / "rows", 9) AS share FROM c"""


def graph_ctes(view: View) -> str:
    return f"""{cells_ctes(view)}, node AS (SELECT DISTINCT v AS node FROM anomalous),
        edge AS (SELECT DISTINCT least(a.v, b.v) AS src, greatest(a.v, b.v) AS dst
            FROM anomalous a JOIN anomalous b ON a.id = b.id AND a.attr < b.attr)"""


def graph_nodes(view: View) -> str:
    return f"WITH {graph_ctes(view)} SELECT node FROM node"


def graph_edges(view: View) -> str:
    return f"WITH {graph_ctes(view)} SELECT src, dst FROM edge"


def pagerank_ctes(view: View, rounds: int, alpha: float = 0.85) -> str:
    """CTEs r0 .. r<rounds>(node, x)."""
    text = f"""{graph_ctes(view)},
        arc AS MATERIALIZED (SELECT src, dst FROM edge UNION ALL SELECT dst, src FROM edge WHERE src <> dst),
        deg AS MATERIALIZED (SELECT src, count(*) AS k FROM arc GROUP BY src),
        size AS MATERIALIZED (SELECT count(*) AS n FROM node),
        r0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE / n AS x FROM node, size)"""
    for k in range(1, rounds + 1):
        before = f"r{k - 1}"
        text += f""",
        g{k} AS (SELECT a.dst AS node, sum({alpha} * r.x / d.k) AS got FROM arc a JOIN deg d ON d.src = a.src
            JOIN {before} r ON r.node = a.src GROUP BY a.dst),
        h{k} AS (SELECT coalesce(sum({alpha} * r.x), 0) AS loose FROM {before} r ANTI JOIN deg d ON d.src = r.node),
        r{k} AS MATERIALIZED (SELECT v.node AS node, coalesce(g.got, 0) + h.loose / s.n + {1.0 - alpha} / s.n AS x
            FROM node v CROSS JOIN size s CROSS JOIN h{k} h LEFT JOIN g{k} g ON g.node = v.node)"""
    return text


def pagerank_fixed(view: View, rounds: int) -> str:
    return f"WITH {pagerank_ctes(view, rounds)} SELECT node, round(x, 9) AS rank FROM r{rounds}"


def pagerank_converged_ctes(view: View, most: int, tol: float = 1e-6) -> str:
    steps = " UNION ALL ".join(
        f"SELECT {k} AS round, sum(abs(r{k}.x - r{k - 1}.x)) AS change FROM r{k} JOIN r{k - 1} USING (node)" for k in range(1, most + 1)
    )
    every = " UNION ALL ".join(f"SELECT {k} AS round, node, x FROM r{k}" for k in range(1, most + 1))
    return f"""{pagerank_ctes(view, most)}, steps AS ({steps}),
        stop AS (SELECT min(round) AS round FROM steps, size WHERE change < n * {tol}),
        final AS (SELECT e.node AS node, e.x AS x FROM ({every}) e JOIN stop ON e.round = stop.round)"""


def pagerank_converged(view: View, most: int) -> str:
    return f"WITH {pagerank_converged_ctes(view, most)} SELECT node, round(x, 9) AS rank FROM final"


# Vectors over the nodes and weights of the edges for the queries with options, alike in Spark and in SQL.
NODE_WEIGHTS = {"personalization": "1 + abs(node) % 7", "nstart": "1 + abs(node) % 3", "dangling": "1 + abs(node) % 5"}
EDGE_WEIGHT = "1 + abs(src - dst) % 4"


def pagerank_options(view: View, rounds: int, directed: bool, weighted: bool, given: tuple[str, ...], alpha: float = 0.85) -> str:
    """Power iteration with weights and vectors; without a dangling vector the personalisation takes its place."""
    weight = EDGE_WEIGHT if weighted else "1.0"
    back = "" if directed else f" UNION ALL SELECT dst, src, {weight} FROM edge WHERE src <> dst"

    def vector(name: str, otherwise: str) -> str:
        return f"({NODE_WEIGHTS[name]}) / sum({NODE_WEIGHTS[name]}) OVER ()" if name in given else otherwise

    uniform = "1.0::DOUBLE / count(*) OVER ()"
    p = vector("personalization", uniform)
    text = f"""{graph_ctes(view)},
        arc AS MATERIALIZED (SELECT src, dst, {weight} AS w FROM edge{back}),
        deg AS MATERIALIZED (SELECT src, sum(w) AS k FROM arc GROUP BY src),
        v AS MATERIALIZED (SELECT node, {p} AS p, {vector("dangling", p)} AS hang, {vector("nstart", uniform)} AS x FROM node),
        r0 AS (SELECT node, x FROM v)"""
    for k in range(1, rounds + 1):
        before = f"r{k - 1}"
        text += f""",
        g{k} AS (SELECT a.dst AS node, sum({alpha} * r.x * a.w / d.k) AS got FROM arc a JOIN deg d ON d.src = a.src
            JOIN {before} r ON r.node = a.src GROUP BY a.dst),
        h{k} AS (SELECT coalesce(sum({alpha} * r.x), 0) AS loose FROM {before} r ANTI JOIN deg d ON d.src = r.node),
        r{k} AS MATERIALIZED (SELECT v.node AS node, coalesce(g.got, 0) + h.loose * v.hang + {1.0 - alpha} * v.p AS x
            FROM v CROSS JOIN h{k} h LEFT JOIN g{k} g ON g.node = v.node)"""
    return f"WITH {text} SELECT node, round(x, 9) AS rank FROM r{rounds}"


def pagerank_positions(view: View, most: int) -> str:
    return f"""WITH {pagerank_converged_ctes(view, most)}, r AS (SELECT node, round(x, 9) AS rank FROM final)
        SELECT node, rank, row_number() OVER (ORDER BY rank DESC, node) - 1 AS position FROM r"""


def graph_ranked(view: View, th: float) -> str:
    return f"""WITH ranked AS ({pagerank_row_score(view)})
        SELECT * FROM ranked WHERE pagerank_score > {_edge("pagerank_score", th)}"""


def attributes_above(view: View, th: float) -> str:
    return f"""WITH {attribute_scores_ctes(view)}
        SELECT attr, name, round(score, 9) AS score FROM scores WHERE score > {1 - th}"""


def ngram_attributes_above(view: View, n: int, band: float, th: float) -> str:
    return f"""SELECT attr, name, score, maximum, normalized_score FROM ({ngram_attr_normalized(view, n, band)})
        WHERE normalized_score > {1 - th}"""


def pagerank_row_score(view: View) -> str:
    return f"""WITH {graph_ctes(view)},
        first AS (SELECT n.node AS node, min(c.id) AS id FROM node n JOIN cell c ON c.v = n.node GROUP BY n.node),
        credited AS (SELECT id, count(*) * ((SELECT count(*) FROM node) - 1) AS score FROM first GROUP BY id)
        SELECT b.id AS {view.key}, coalesce(score, 0)::BIGINT AS pagerank_score FROM base b LEFT JOIN credited c ON c.id = b.id"""


def attribute_scores_ctes(view: View) -> str:
    d = len(view.attrs)
    names = ", ".join(f"({a}, '{n}')" for a, n in enumerate(view.attrs))
    return f"""{cells_ctes(view)}, names(attr, name) AS (VALUES {names}),
        scores AS (SELECT n.attr AS attr, n.name AS name, coalesce(sum(t.part), 0) /
            ((SELECT count(*) FROM base) * {1 + (d - 1) ** 2}) AS score
            FROM names n LEFT JOIN taken t ON t.attr = n.attr GROUP BY n.attr, n.name)"""


def attribute_scores(view: View) -> str:
    return f"WITH {attribute_scores_ctes(view)} SELECT attr, name, round(score, 9) AS score FROM scores"


def attribute_summary(view: View, function: str) -> str:
    sql = "avg" if function == "mean" else "median"
    return f"""WITH {attribute_scores_ctes(view)} SELECT '{function}' AS function, round({sql}(score), 9) AS table_score FROM scores"""


# ---------------------------------------------------------------- isolation forest


def iforest_scores(
    view: View,
    trees: int,
    sets=None,
    split: float = 0.5,
    sample_seed: int = 0,
    most: int = 256,
    levels: int = 8,
    seed: int = 42,
    share: float | None = None,
) -> str:
    """A forest per feature set: sub-samples by hashes of the keys, trees level by level by hashes of their nodes.

    Scores above 0.5 are outliers, or with a ``share`` those above the percentile of the sample's scores to 9 digits.

    ``sets`` are (number, reported attributes, read attributes); values a set does not read are null. For samples of
    129 rows at least, for which trees have ``levels`` levels.
    """
    sets = sets or [(i, c, c) for i, c in _sets(len(view.attrs))]
    points = " UNION ALL ".join(
        f"SELECT {i} AS set_id, {', '.join(f'a{c[k]} AS v{k}' if k < len(c) else f'NULL::DOUBLE AS v{k}' for k in range(3))}, * FROM {{0}}"
        for i, _, c in sets
    )
    length = "CASE WHEN n <= 1 THEN 0.0 WHEN n = 2 THEN 1.0 ELSE 2.0 * (ln(n - 1) + 0.57721566490153286) - 2.0 * (n - 1) / n END"
    ctes = [
        f"base AS ({view.base})",
        sample_cte(split, sample_seed),
        f"pool AS MATERIALIZED (SELECT * FROM smp QUALIFY row_number() OVER (ORDER BY md5(id || ':{seed + 1}')) <= {trees * most})",
        f"plan AS MATERIALIZED (SELECT psi, n // psi AS blocks, CAST(ceil({trees} / (n // psi)) AS BIGINT) AS deals"
        f" FROM (SELECT count(*) AS n, least({most}, count(*)) AS psi FROM pool))",
        f"dealt AS (SELECT p.*, blocks, d AS deal, (row_number() OVER (PARTITION BY d ORDER BY md5(md5(id || ':{seed + 2}') || ':0:' || d)) - 1)"
        f" // psi AS block FROM pool p, plan, unnest(range(deals)) AS t(d))",
        f"drawn AS MATERIALIZED (SELECT * EXCLUDE (blocks, deal, block), deal * blocks + block AS tree FROM dealt"
        f" WHERE block < blocks AND deal * blocks + block < {trees})",
        f"r0 AS MATERIALIZED (SELECT *, 0::BIGINT AS node FROM ({points.format('drawn')}))",
    ]
    # the place of the chosen one among the features that vary
    usable = [f"coalesce((h{k} > l{k})::INTEGER, 0)" for k in range(3)]
    pick = (
        f"CASE WHEN u0 = 1 AND (num % (u0 + u1 + u2)) = 0 THEN 0 WHEN u1 = 1 AND (num % (u0 + u1 + u2)) = u0 THEN 1 ELSE 2 END"
    )
    for k in range(levels):
        ends = ", ".join(f"min(v{j}) AS l{j}, max(v{j}) AS h{j}" for j in range(3))
        flags = ", ".join(f"{usable[j]} AS u{j}" for j in range(3))
        drawn = f"md5('{seed}:0:' || tree || ':' || set_id || ':' || node)"
        ctes.append(
            f"s{k} AS MATERIALIZED (SELECT *, {flags}, CAST('0x' || substr({drawn}, 1, 8) AS BIGINT) AS num,"
            f" CAST('0x' || substr({drawn}, 9, 13) AS BIGINT) / 4503599627370496.0 AS share"
            f" FROM (SELECT set_id, tree, node, count(*) AS n, {ends} FROM r{k} GROUP BY set_id, tree, node))"
        )
        ctes.append(
            f"p{k} AS MATERIALIZED (SELECT set_id, tree, node, n, f, CASE f WHEN 0 THEN least(l0 + share * (h0 - l0), nextafter(h0, l0))"
            f" WHEN 1 THEN least(l1 + share * (h1 - l1), nextafter(h1, l1)) WHEN 2 THEN least(l2 + share * (h2 - l2), nextafter(h2, l2)) END AS cut"
            f" FROM (SELECT *, CASE WHEN n > 1 AND u0 + u1 + u2 > 0 THEN {pick} END AS f FROM s{k}))"
        )
        moved = "2 * r.node + CASE WHEN (CASE f WHEN 0 THEN v0 WHEN 1 THEN v1 ELSE v2 END) <= cut THEN 1 ELSE 2 END AS node"
        ctes.append(
            f"r{k + 1} AS MATERIALIZED (SELECT r.* EXCLUDE (node), {moved} FROM r{k} r JOIN p{k} p"
            f" ON r.set_id = p.set_id AND r.tree = p.tree AND r.node = p.node WHERE f IS NOT NULL)"
        )
    leaves = [f"SELECT set_id, tree, node, {k} + ({length}) AS path FROM p{k} WHERE f IS NULL" for k in range(levels)]
    leaves.append(f"SELECT set_id, tree, node, {levels} + ({length}) AS path FROM (SELECT set_id, tree, node, count(*) AS n FROM r{levels} GROUP BY ALL)")
    ctes.append(f"leaf AS MATERIALIZED ({' UNION ALL '.join(leaves)})")
    ctes.append(f"w0 AS (SELECT *, 0::BIGINT AS node FROM ({points.format('base')}), unnest(range({trees})) AS t(tree))")
    for k in range(levels):
        value = "CASE f WHEN 0 THEN v0 WHEN 1 THEN v1 ELSE v2 END"
        ctes.append(
            f"w{k + 1} AS (SELECT w.* EXCLUDE (node), CASE WHEN f IS NULL THEN w.node ELSE 2 * w.node + CASE WHEN ({value}) <= cut THEN 1 ELSE 2 END END AS node"
            f" FROM w{k} w LEFT JOIN p{k} p ON w.set_id = p.set_id AND w.tree = p.tree AND w.node = p.node)"
        )
    labels = ", ".join(f"({i}, '{'-'.join(map(str, c))}')" for i, c, _ in sets)
    if share is not None:
        return f"""WITH {', '.join(ctes)}, names(set_id, attrs) AS (VALUES {labels}),
        scored AS MATERIALIZED (SELECT id, w.set_id AS set_id, round(pow(2.0, -avg(path) / (SELECT {length} FROM (SELECT psi AS n FROM plan))), 9) AS score
            FROM w{levels} w JOIN leaf l ON w.set_id = l.set_id AND w.tree = l.tree AND w.node = l.node GROUP BY id, w.set_id),
        thr AS MATERIALIZED (SELECT set_id, quantile_cont(score, {1 - share}) AS t FROM scored SEMI JOIN smp USING (id) GROUP BY set_id)
        SELECT id AS {view.key}, attrs, round(score, 6) AS score, score > t AS is_outlier FROM scored JOIN names USING (set_id) JOIN thr USING (set_id)"""
    return f"""WITH {', '.join(ctes)}, names(set_id, attrs) AS (VALUES {labels}),
        scored AS (SELECT id, w.set_id AS set_id, pow(2.0, -avg(path) / (SELECT {length} FROM (SELECT psi AS n FROM plan))) AS score
            FROM w{levels} w JOIN leaf l ON w.set_id = l.set_id AND w.tree = l.tree AND w.node = l.node GROUP BY id, w.set_id)
        SELECT id AS {view.key}, attrs, round(score, 6) AS score, score > 0.5 AS is_outlier FROM scored JOIN names USING (set_id)"""


def _wide_forest(view: View, scores: str) -> str:
    places = ", ".join(f"('{'-'.join(map(str, c))}', {i}, {len(c)})" for i, c in _sets(len(view.attrs)))
    wide = ", ".join(
        f"coalesce(string_agg(CASE WHEN arity = {r} AND is_outlier THEN attrs END, ',' ORDER BY set_id), '') AS {c}"
        for r, c in ((1, '"single_IF"'), (2, '"pairs_IF"'), (3, '"triplets_IF"'))
    )
    return f"SELECT {view.key}, {wide} FROM ({scores}) JOIN (VALUES {places}) AS t(attrs, set_id, arity) USING (attrs) GROUP BY {view.key}"


def iforest_wide(view: View, trees: int) -> str:
    return _wide_forest(view, iforest_scores(view, trees))


def iforest_rank_cutoff(view: View, trees: int, th: float) -> str:
    places = ", ".join(f"('{'-'.join(map(str, c))}', {i})" for i, c in _sets(len(view.attrs)))
    flags = f"""base AS ({view.base}), flag AS MATERIALIZED (SELECT {view.key} AS id, set_id, is_outlier
        FROM ({iforest_scores(view, trees)}) JOIN (VALUES {places}) AS t(attrs, set_id) USING (attrs))"""
    return f"""WITH {rank_count_ctes(view, flags=flags)} SELECT * FROM ranked WHERE "Ranking_count" > {_edge("Ranking_count", th)}"""


def iforest_wide_compat(view: View, trees: int) -> str:
    """Single attributes beside attribute d - 2 and inverted, none for the last two; pairs from a sample of their own."""
    d = len(view.attrs)
    single = [(i, c, (c[0], d - 2)) for i, c in _sets(d) if len(c) == 1 and c[0] < d - 2]
    pairs = [(i, c, c) for i, c in _sets(d) if len(c) == 2]
    triplets = [(i, c, c) for i, c in _sets(d) if len(c) == 3]
    scores = f"""SELECT {view.key}, attrs, CASE WHEN strpos(attrs, '-') = 0 THEN NOT is_outlier ELSE is_outlier END AS is_outlier
        FROM ({iforest_scores(view, trees, single + triplets)})
        UNION ALL SELECT {view.key}, attrs, is_outlier FROM ({iforest_scores(view, 100, pairs, 0.2, 7)})"""
    return _wide_forest(view, scores)


# ---------------------------------------------------------------- random cuts, products, labels


def random_cuts(table: str, keys: list[str], attrs: list[str], weights, contamination: float = 0.1, bins: int = 10) -> str:
    """One projection column per cut; the weights are written with exponents, which makes them doubles."""
    cuts = range(len(weights))
    sums = [" + ".join(f"{a} * ({w:.17e})" for a, w in zip(attrs, line) if w) for line in weights]
    projected = ", ".join(f"{s} AS p{c}" for c, s in enumerate(sums))
    ranges = ", ".join(f"min(p{c}) AS lo{c}, max(p{c}) AS hi{c}" for c in cuts)
    places = ", ".join(f"least({bins - 1}, greatest(0, floor((p{c} - lo{c}) / ((hi{c} - lo{c}) / {bins}))))::INTEGER" for c in cuts)
    names = ", ".join(keys)
    return f"""WITH base AS (SELECT {names}, row_number() OVER () AS rid, {projected} FROM {table}),
        edges AS (SELECT {ranges}, count(*) AS n FROM base),
        long AS (SELECT rid, n, unnest([{places}]) AS b, unnest(range({len(weights)})) AS cut FROM base, edges),
        hist AS (SELECT cut, b, count(*) AS c FROM long GROUP BY cut, b),
        scored AS (SELECT l.rid AS rid, round(avg(-ln(h.c / l.n)), 9) AS score
            FROM long l JOIN hist h ON h.cut = l.cut AND h.b = l.b GROUP BY l.rid),
        thr AS (SELECT quantile_cont(score, {1 - contamination}) AS t FROM scored)
        SELECT {names}, round(score, 6) AS score, score > t AS is_outlier FROM base JOIN scored ON base.rid = scored.rid, thr"""


def product_features(table: str, keys: list[str], attrs: list[str]) -> str:
    columns = [
        f"round({' * '.join(attrs[a] for a in c)}, 6) AS x_{'_'.join(map(str, c))}"
        for arity in (2, 3)
        for c in combinations(range(len(attrs)), arity)
    ]
    return f"SELECT {', '.join(keys)}, {', '.join(columns)} FROM {table}"


def autoencoder_inputs(view: View, split: float = 0.5) -> str:
    lines = " UNION ALL ".join(
        f"SELECT '{'-'.join(map(str, c))}' AS attrs, round(avg({' * '.join(f'a{a}' for a in c)}), 6) AS mean, "
        f"round(coalesce(nullif(stddev_pop({' * '.join(f'a{a}' for a in c)}), 0), 1), 6) AS deviation FROM smp"
        for _, c in _sets(len(view.attrs))
    )
    return f"WITH base AS ({view.base}), {sample_cte(split)} {lines}"


def autoencoder_steps(
    view: View, spec: NetSpec, steps: int, batches: int, share: float = 0.1, split: float = 0.5, seed: int = 0, digits: int = 9
) -> str:
    """A network per feature set, its weights by exact steps: forward, backward and update as joins and sums.

    Weights are rows (set_id, l, i, j, w, m, v), a bias has i = -1. For one input, tanh and a sigmoid at the end.
    """
    widths, last = spec.widths, len(spec.widths) - 1
    sets = _sets(len(view.attrs))
    products = " UNION ALL ".join(f"SELECT {i} AS set_id, id, {' * '.join(f'a{a}' for a in c)} AS p FROM {{0}}" for i, c in sets)
    number = f"CAST('0x' || substr(md5(id || ':{seed + 4}'), 1, {DRAW_DIGITS}) AS BIGINT)"
    first = " UNION ALL ".join(
        f"SELECT set_id, {l} AS l, i, j, {math.sqrt(6.0 / (a + b))!r}::DOUBLE * (2.0 * (CAST('0x' || substr(md5('{seed}:' || set_id || ':{l}:' || i || ':' || j), 1, 13)"
        f" AS BIGINT) / 4503599627370496.0) - 1.0) AS w FROM stat, unnest(range({a})) AS x(i), unnest(range({b})) AS y(j)"
        f" UNION ALL SELECT set_id, {l}, -1, j, 0.0 FROM stat, unnest(range({b})) AS y(j)"
        for l, (a, b) in enumerate(zip(widths, widths[1:]), start=1)
    )
    ctes = [
        f"base AS ({view.base})",
        sample_cte(split),
        f"stat AS MATERIALIZED (SELECT set_id, avg(p) AS mean, coalesce(nullif(stddev_pop(p), 0), 1) AS dev FROM ({products.format('smp')}) GROUP BY set_id)",
        f"x AS MATERIALIZED (SELECT set_id, id, 0 AS j, (p - mean) / dev AS h FROM ({products.format('base')}) JOIN stat USING (set_id))",
        f"drawn AS MATERIALIZED (SELECT id, {number} AS num FROM smp)",
        f"w0 AS MATERIALIZED (SELECT *, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v FROM ({first}))",
    ]

    def layer(l: int, before: str, weights: str) -> str:
        """(set_id, id, j, z) of layer ``l``."""
        return f"""SELECT s.set_id AS set_id, s.id AS id, s.j AS j, s.z + b.w AS z FROM (SELECT h.set_id AS set_id, h.id AS id, w.j AS j, sum(h.h * w.w) AS z
            FROM {before} h JOIN {weights} w ON w.set_id = h.set_id AND w.i = h.j WHERE w.l = {l} GROUP BY h.set_id, h.id, w.j) s
            JOIN {weights} b ON b.set_id = s.set_id AND b.j = s.j WHERE b.l = {l} AND b.i = -1"""

    mix = f"(x * x + {DRAW_FACTOR} * x + 11) % {DRAW_PRIME}"
    keep = 1.0 - spec.dropout
    for t in range(steps):
        w = f"w{t}"
        ctes.append(f"h{t}_0 AS MATERIALIZED (SELECT x.* FROM x JOIN drawn USING (id) WHERE num % {batches} = {t % batches})")
        ctes.append(f"n{t} AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM drawn WHERE num % {batches} = {t % batches})")
        for l in range(1, last):
            start = f"num + {DRAW_STEPS['step'] * t + DRAW_STEPS['layer'] * l} + {DRAW_STEPS['network']} * set_id + {DRAW_STEPS['unit']} * j"
            ctes.append(
                f"""a{t}_{l} AS MATERIALIZED (SELECT set_id, id, j, tanh(z) AS a, CASE WHEN d / {DRAW_PRIME}.0 >= {spec.dropout} THEN 1 / {keep!r}::DOUBLE ELSE 0.0 END AS mask
                FROM (SELECT * EXCLUDE (x), {mix} AS d FROM (SELECT * EXCLUDE (x), {mix} AS x FROM
                    (SELECT f.*, ({start}) % {DRAW_PRIME} AS x FROM ({layer(l, f"h{t}_{l - 1}", w)}) f JOIN drawn USING (id)))))"""
            )
            ctes.append(f"h{t}_{l} AS (SELECT set_id, id, j, a * mask AS h FROM a{t}_{l})")
        out = layer(last, f"h{t}_{last - 1}", w)
        ctes.append(f"o{t} AS (SELECT f.set_id AS set_id, f.id AS id, f.j AS j, 1 / (1 + exp(-z)) AS o, h AS x FROM ({out}) f JOIN h{t}_0 h ON h.set_id = f.set_id AND h.id = f.id)")
        ctes.append(f"d{t}_{last} AS MATERIALIZED (SELECT set_id, id, j, (2 * (o - x) / n + {2 * spec.activity_l2} * o / n) * o * (1 - o) AS d FROM o{t}, n{t})")
        for l in range(last - 1, 0, -1):
            ctes.append(
                f"""d{t}_{l} AS MATERIALIZED (SELECT a.set_id AS set_id, a.id AS id, a.j AS j, (back * mask + {2 * spec.activity_l2} * a / n) * (1 - a * a) AS d
                FROM a{t}_{l} a JOIN (SELECT d.set_id AS set_id, d.id AS id, w.i AS j, sum(d.d * w.w) AS back FROM d{t}_{l + 1} d
                    JOIN {w} w ON w.set_id = d.set_id AND w.j = d.j WHERE w.l = {l + 1} AND w.i >= 0 GROUP BY d.set_id, d.id, w.i) b
                ON b.set_id = a.set_id AND b.id = a.id AND b.j = a.j, n{t})"""
            )
        slopes = " UNION ALL ".join(
            f"""SELECT h.set_id AS set_id, {l} AS l, h.j AS i, d.j AS j, sum(h.h * d.d) AS g FROM h{t}_{l - 1} h
                JOIN d{t}_{l} d ON d.set_id = h.set_id AND d.id = h.id GROUP BY h.set_id, h.j, d.j
                UNION ALL SELECT set_id, {l}, -1, j, sum(d) FROM d{t}_{l} GROUP BY set_id, j"""
            for l in range(1, last + 1)
        )
        rate = spec.learning_rate * math.sqrt(1.0 - 0.999 ** (t + 1)) / (1.0 - 0.9 ** (t + 1))
        ctes.append(
            f"""w{t + 1} AS MATERIALIZED (SELECT set_id, l, i, j, w - {rate!r}::DOUBLE * m / (sqrt(v) + 1e-7) AS w, m, v FROM (SELECT w.set_id AS set_id, w.l AS l,
                w.i AS i, w.j AS j, w, 0.9 * m + 0.1 * g AS m, 0.999 * v + 0.001 * g * g AS v FROM {w} w
                JOIN ({slopes}) g ON g.set_id = w.set_id AND g.l = w.l AND g.i = w.i AND g.j = w.j))"""
        )
    before = "x"
    for l in range(1, last):
        ctes.append(f"f{l} AS MATERIALIZED (SELECT set_id, id, j, tanh(z) AS h FROM ({layer(l, before, f'w{steps}')}))")
        before = f"f{l}"
    names = ", ".join(f"({i}, '{'-'.join(map(str, c))}')" for i, c in sets)
    return f"""WITH {', '.join(ctes)}, names(set_id, attrs) AS (VALUES {names}),
        scored AS MATERIALIZED (SELECT x.id AS id, x.set_id AS set_id, round(abs(x.h - 1 / (1 + exp(-z))), {digits}) AS score
            FROM x JOIN ({layer(last, before, f"w{steps}")}) f ON f.set_id = x.set_id AND f.id = x.id),
        thr AS MATERIALIZED (SELECT set_id, quantile_cont(score, {1 - share}) AS t FROM scored SEMI JOIN smp USING (id) GROUP BY set_id)
        SELECT id AS {view.key}, attrs, round(score, 6) AS score, score > t AS is_outlier FROM scored JOIN names USING (set_id) JOIN thr USING (set_id)"""


def evaluate_flags(view: View) -> str:
    return f"""WITH {loda_ctes(view)},
        judged AS (SELECT id, CAST(bool_or(is_outlier) AS INTEGER) AS prediction FROM flag GROUP BY id),
        c AS (SELECT count(*) FILTER (prediction = 1 AND quality = 0) AS tp, count(*) FILTER (prediction = 0 AND quality = 1) AS tn,
            count(*) FILTER (prediction = 1 AND quality = 1) AS fp, count(*) FILTER (prediction = 0 AND quality = 0) AS fn
            FROM judged JOIN labels ON labels.doc_id = judged.id)
        SELECT tp, tn, fp, fn, round((tp + tn) / (tp + tn + fp + fn), 9) AS accuracy,
            CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 9) END AS precision,
            CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 9) END AS recall FROM c"""


def stratified_folds(splits: int, repeats: int, seed: int = 0) -> str:
    return f"""WITH marked AS (SELECT d.doc_id AS doc_id, 1 - l.quality AS truth FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
        repeated AS (SELECT doc_id, truth, r::INTEGER AS repeat FROM marked CROSS JOIN (SELECT unnest(range({repeats})) AS r))
        SELECT doc_id, truth, repeat, ((row_number() OVER (PARTITION BY repeat, truth
            ORDER BY md5(CAST(doc_id AS VARCHAR) || ':{seed}:' || CAST(repeat AS VARCHAR))) - 1) % {splits})::INTEGER AS fold FROM repeated"""


def forest_search(
    view: View, truth: str, trees: tuple[int, ...], splits: int, repeats: int, winner: bool = False, most: int = 256, levels: int = 8, seed: int = 1
) -> str:
    """Accuracy of each number of trees: a forest per repeat and fold, whose first trees are the smaller candidates.

    ``truth`` gives (id, truth). A row is judged in each repeat by the forest grown without its fold. Trees are grown and
    walked level by level, no deeper than the sub-samples ask for; for three attributes.
    """
    full = max(trees)
    length = "CASE WHEN n <= 1 THEN 0.0 WHEN n = 2 THEN 1.0 ELSE 2.0 * (ln(n - 1) + 0.57721566490153286) - 2.0 * (n - 1) / n END"
    value = "CASE f WHEN 0 THEN a0 WHEN 1 THEN a1 ELSE a2 END"
    ctes = [
        f"base AS ({view.base})",
        f"marked AS MATERIALIZED (SELECT * FROM base JOIN ({truth}) USING (id))",
        f"""folds AS MATERIALIZED (SELECT m.*, r, ((row_number() OVER (PARTITION BY r, truth ORDER BY md5(id || ':{seed}:' || r)) - 1) % {splits}) AS fold
            FROM marked m, unnest(range({repeats})) AS t(r))""",
        f"""pool AS MATERIALIZED (SELECT f.*, r * {splits} + o AS forest FROM folds f SEMI JOIN (SELECT id FROM marked
                QUALIFY row_number() OVER (ORDER BY md5(id || ':{seed}')) <= {2 * full * most}) USING (id), unnest(range({splits})) AS t(o) WHERE o <> fold)""",
        "sizes AS MATERIALIZED (SELECT forest, count(*) AS size FROM pool GROUP BY forest)",
        f"plan AS MATERIALIZED (SELECT psi, greatest(1, ceil(log2(greatest(psi, 2)))) AS depth FROM (SELECT least({most}, min(size)) AS psi FROM sizes))",
        f"""dealt AS (SELECT p.*, size // psi AS blocks, psi, d AS deal, row_number() OVER (PARTITION BY forest, d
                ORDER BY md5(md5(id || ':{seed + 2}') || ':' || forest || ':' || d)) - 1 AS place
            FROM pool p JOIN sizes USING (forest), plan, unnest(range(CAST(ceil({full} / (size // psi)) AS BIGINT))) AS t(d))""",
        f"""r0 AS MATERIALIZED (SELECT forest, deal * blocks + place // psi AS tree, a0, a1, a2, 0::BIGINT AS node FROM dealt
            WHERE place // psi < blocks AND deal * blocks + place // psi < {full})""",
    ]
    pick = "CASE WHEN u0 = 1 AND (num % (u0 + u1 + u2)) = 0 THEN 0 WHEN u1 = 1 AND (num % (u0 + u1 + u2)) = u0 THEN 1 ELSE 2 END"
    for k in range(levels + 1):
        ends = ", ".join(f"min(a{j}) AS l{j}, max(a{j}) AS h{j}" for j in range(3))
        drawn = f"md5('{seed}:' || forest || ':' || tree || ':0:' || node)"
        cuts = " ".join(f"WHEN {j} THEN least(l{j} + share * (h{j} - l{j}), nextafter(h{j}, l{j}))" for j in range(3))
        ctes.append(
            f"""p{k} AS MATERIALIZED (SELECT forest, tree, node, n, f, CASE f {cuts} END AS cut FROM
                (SELECT *, CASE WHEN n > 1 AND u0 + u1 + u2 > 0 AND {k} < (SELECT depth FROM plan) THEN {pick} END AS f FROM
                (SELECT *, {', '.join(f'(h{j} > l{j})::INTEGER AS u{j}' for j in range(3))}, CAST('0x' || substr({drawn}, 1, 8) AS BIGINT) AS num,
                    CAST('0x' || substr({drawn}, 9, 13) AS BIGINT) / 4503599627370496.0 AS share
                FROM (SELECT forest, tree, node, count(*) AS n, {ends} FROM r{k} GROUP BY forest, tree, node))))"""
        )
        if k < levels:
            ctes.append(
                f"""r{k + 1} AS MATERIALIZED (SELECT r.forest AS forest, r.tree AS tree, a0, a1, a2, 2 * r.node + CASE WHEN ({value}) <= cut THEN 1 ELSE 2 END AS node
                FROM r{k} r JOIN p{k} p ON r.forest = p.forest AND r.tree = p.tree AND r.node = p.node WHERE f IS NOT NULL)"""
            )
    ctes.append(f"w0 AS (SELECT id, truth, a0, a1, a2, r, fold, r * {splits} + fold AS forest, tree, 0::BIGINT AS node, NULL::DOUBLE AS path FROM folds, unnest(range({full})) AS t(tree))")
    for k in range(levels + 1):
        ctes.append(
            f"""w{k + 1} AS (SELECT w.* EXCLUDE (node, path), CASE WHEN path IS NULL AND f IS NOT NULL THEN 2 * w.node + CASE WHEN ({value}) <= cut THEN 1 ELSE 2 END
                    ELSE w.node END AS node, CASE WHEN path IS NULL AND f IS NULL THEN {k} + ({length}) ELSE path END AS path
                FROM w{k} w LEFT JOIN p{k} p ON w.forest = p.forest AND w.tree = p.tree AND w.node = p.node)"""
        )
    sizes = ", ".join(f"({i}, {t})" for i, t in enumerate(trees))
    ctes.append(f"tried(candidate, trees) AS (VALUES {sizes})")
    ctes.append(
        f"""judged AS (SELECT candidate, trees, id, truth, r, fold, sum(path) / trees < (SELECT {length} FROM (SELECT psi AS n FROM plan)) AS outlier
            FROM w{levels + 1} JOIN tried ON tree < trees GROUP BY candidate, trees, id, truth, r, fold)"""
    )
    ctes.append("fits AS (SELECT candidate, trees, r, fold, avg((outlier = (truth = 1))::INTEGER) AS accuracy FROM judged GROUP BY candidate, trees, r, fold)")
    ctes.append("scored AS (SELECT candidate, trees, round(avg(accuracy), 9) AS accuracy, count(*) AS fits FROM fits GROUP BY candidate, trees)")
    return f"WITH {', '.join(ctes)} SELECT * FROM scored" + (" ORDER BY accuracy DESC, candidate LIMIT 1" if winner else "")
