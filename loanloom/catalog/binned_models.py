"""Models on binned features, with twins that fit every fold's training side from its own rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanloom.catalog.learning import NUMBERS
from loanloom.catalog.registry import query, r4, rounded, sql_r4
from loanloom.operators import binned, model
from loanloom.operators.binned import SplitSetting
from loanloom.operators.split import stratified_folds
from loanloom.operators.spread import spread

# The order of the split, which both engines compute alike.
_ORDER = "(SK_ID_CURR * 2654435761) % 1000003"
BINS = 32
GRID = [SplitSetting(i, s) for i in ("gini", "entropy") for s in (0.0, 0.01, 0.05, 0.2, 0.4)]
SHARES = [0.0, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5]


def _rows(t, folds: int):
    """Binned applicants, with folds if asked for."""
    rows = t.application.select("SK_ID_CURR", F.col("TARGET").cast("long").alias("TARGET"), *NUMBERS)
    rows = spread(rows, "SK_ID_CURR")
    if not folds:
        return binned.binned(rows, binned.fit_bins(rows, NUMBERS, BINS), ["SK_ID_CURR", "TARGET"])
    placed = stratified_folds(rows, "TARGET", "SK_ID_CURR", folds, order=F.expr(_ORDER), order_max=1_000_003)
    return binned.binned(placed, binned.fit_bins(rows, NUMBERS, BINS), ["SK_ID_CURR", "TARGET", "fold"])


def _counts(t, folds: int):
    return binned.count_bins(_rows(t, folds), "TARGET", folds)


# --- twins ------------------------------------------------------------------------------------

_G, _S = "1e9", "0.41421356e0"


def _sql_bin(c: str) -> str:
    place = f"floor((CAST({c} AS DOUBLE) - lo_{c}) / (hi_{c} - lo_{c}) * {BINS}e0) + 1"
    return f"CASE WHEN {c} IS NULL THEN 0 WHEN lo_{c} = hi_{c} THEN 1 ELSE greatest(1, least({place}, {BINS})) END"


def _sql_long(folds: int) -> str:
    """``placed``: key, label, fold; ``long``: those with place, feature and bin; ``held``: the folds and -1 for none held out."""
    extremes = ", ".join(f"CAST(min({c}) AS DOUBLE) AS lo_{c}, CAST(max({c}) AS DOUBLE) AS hi_{c}" for c in NUMBERS)
    singles = " UNION ALL ".join(
        f"SELECT SK_ID_CURR, TARGET, fold, {i} AS place, '{c}' AS feature, CAST({_sql_bin(c)} AS INT) AS bin FROM placed, extremes"
        for i, c in enumerate(NUMBERS)
    )
    return f"""WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY TARGET ORDER BY {_ORDER}, SK_ID_CURR) AS r,
          count(*) OVER (PARTITION BY TARGET) AS n FROM {{application}}),
        placed AS (SELECT * REPLACE (CAST(TARGET AS BIGINT) AS TARGET),
          CAST(len(list_filter(range(1, {folds}), lambda i: r > n * i // {folds})) AS INT) AS fold FROM ranked),
        extremes AS (SELECT {extremes} FROM {{application}}), long AS ({singles}),
        held AS (SELECT CAST(unnest(range(-1, {folds})) AS INT) AS h)"""


def _sql_impurity(kind: str, n: str, p: str) -> str:
    ones, zeros = f"({p} * 1e0 / {n})", f"(({n} - {p}) * 1e0 / {n})"
    if kind == "gini":
        return f"(2 * {ones} * {zeros})"
    return f"(CASE WHEN {p} > 0 THEN -{ones} * log2({ones}) ELSE 0 END + CASE WHEN {p} < {n} THEN -{zeros} * log2({zeros}) ELSE 0 END)"


def _sql_trees(folds: int, settings: list[SplitSetting]) -> str:
    """``trees``: the best split per fold held out and setting, by joining the training rows of every fold anew."""
    tried = " UNION ALL ".join(
        f"""SELECT h, {i} AS setting, CASE WHEN ln < n THEN place ELSE -1 END AS place, feature, cut, ln, lp, n, p,
            CASE WHEN ln = n THEN 0 ELSE floor(({_sql_impurity(s.impurity, 'n', 'p')} - (ln * 1e0 / n * {_sql_impurity(s.impurity, 'ln', 'lp')}
              + (n - ln) * 1e0 / n * {_sql_impurity(s.impurity, '(n - ln)', '(p - lp)')})) * {_G} + {_S}) END AS gain
            FROM splits WHERE (ln = n AND place = 0 AND final) OR (ln < n AND ln >= n * {float(s.least_share)!r}e0 AND n - ln >= n * {float(s.least_share)!r}e0)"""
        for i, s in enumerate(settings)
    )
    return f"""{_sql_long(folds)},
        trained AS (SELECT h, place, feature, bin, count(*) AS c, sum(TARGET) AS cp FROM long JOIN held ON fold <> h GROUP BY ALL),
        cuts AS (SELECT DISTINCT place, bin AS cut, bin = max(bin) OVER (PARTITION BY place) AS final FROM long),
        splits AS (SELECT h, place, feature, cut, any_value(final) AS final, sum(c) AS n, sum(cp) AS p,
            coalesce(sum(c) FILTER (WHERE bin <= cut), 0) AS ln, coalesce(sum(cp) FILTER (WHERE bin <= cut), 0) AS lp
          FROM trained JOIN cuts USING (place) GROUP BY h, place, feature, cut HAVING ln > 0),
        tried AS ({tried}),
        trees AS (SELECT * EXCLUDE (o), lp * 1e0 / ln AS sl, CASE WHEN place < 0 THEN lp * 1e0 / ln ELSE (p - lp) * 1e0 / (n - ln) END AS sr
          FROM (SELECT *, row_number() OVER (PARTITION BY h, setting ORDER BY gain DESC, place, cut) AS o FROM tried) x WHERE o = 1)"""


def _sql_auc(rows: str, keys: str) -> str:
    """AUC per group of ``rows`` (columns s, y) by average ranks."""
    return f"""SELECT {keys}, (sum(CASE WHEN y = 1 THEN mid ELSE 0 END) - p * (p + 1) / 2e0) / nullif(p * (n - p), 0) AS auc FROM (
        SELECT {keys}, y, rank() OVER (PARTITION BY {keys} ORDER BY s) + (count(*) OVER (PARTITION BY {keys}, s) - 1) / 2e0 AS mid,
          CAST(sum(y) OVER (PARTITION BY {keys}) AS DOUBLE) AS p, CAST(count(*) OVER (PARTITION BY {keys}) AS DOUBLE) AS n FROM ({rows}) x) z
        GROUP BY {keys}, p, n"""


def _sql_tree_scores(folds: int, settings: list[SplitSetting]) -> str:
    """``scores``: per fold and setting the tree and its figures, every row scored one by one."""
    scored = "SELECT h, setting, fold, TARGET AS y, CASE WHEN t.place < 0 OR bin <= cut THEN sl ELSE sr END AS s FROM trees t JOIN long l ON l.place = greatest(t.place, 0) WHERE h >= 0"
    return f"""{_sql_trees(folds, settings)},
        scored AS ({scored}),
        train AS ({_sql_auc('SELECT * FROM scored WHERE fold <> h', 'h, setting')}),
        valid AS ({_sql_auc('SELECT * FROM scored WHERE fold = h', 'h, setting')}),
        hits AS (SELECT h, setting, avg(CASE WHEN (s > 0.5) = (y = 1) THEN 1e0 ELSE 0e0 END) AS accuracy,
          coalesce(2e0 * count(*) FILTER (WHERE s > 0.5 AND y = 1) / nullif(count(*) FILTER (WHERE s > 0.5) + sum(y), 0), 0) AS f1
          FROM scored WHERE fold = h GROUP BY h, setting),
        scores AS (SELECT h AS fold, setting, CASE WHEN place >= 0 THEN feature END AS feature, CASE WHEN place >= 0 THEN cut END AS cut,
          train.auc AS train_auc, valid.auc AS roc_auc, accuracy, f1
          FROM trees JOIN train USING (h, setting) JOIN valid USING (h, setting) JOIN hits USING (h, setting))"""


def _sql_points(folds: int) -> str:
    """``pointed``: rows with the points of the card fitted without their fold (h = fold) and on all rows (h = -1)."""
    return f"""{_sql_long(folds)},
        sized AS (SELECT h, count(*) AS n, sum(TARGET) AS p FROM placed JOIN held ON fold <> h GROUP BY h),
        kinds AS (SELECT place, count(DISTINCT bin) AS k FROM long GROUP BY place),
        seen AS (SELECT DISTINCT place, bin FROM long),
        card AS (SELECT h, place, bin, floor((ln((coalesce(cp, 0) + 1) * 1e0 / (p + k)) - ln((coalesce(c, 0) - coalesce(cp, 0) + 1) * 1e0 / (n - p + k))) * 1000e0 + {_S}) AS points
          FROM seen JOIN kinds USING (place) CROSS JOIN sized
          LEFT JOIN (SELECT h, place, bin, count(*) AS c, sum(TARGET) AS cp FROM long JOIN held ON fold <> h GROUP BY ALL) q USING (h, place, bin)),
        pointed AS (SELECT h, SK_ID_CURR, fold, TARGET AS y, sum(points) + any_value(floor(ln((p + 1) * 1e0 / (n - p + 1)) * 1000e0 + {_S})) AS s
          FROM long JOIN card USING (place, bin) JOIN sized USING (h) WHERE h = fold OR h = -1 GROUP BY ALL)"""


# --- queries ----------------------------------------------------------------------------------


@query(
    "m7_split_cv",
    f"""{_sql_tree_scores(10, GRID)} SELECT fold, setting, feature, cut, {', '.join(f'{sql_r4(c)} AS {c}' for c in ('train_auc', 'roc_auc', 'accuracy', 'f1'))} FROM scores""",
)
def _(t):
    return rounded(binned.cross_validate_splits(_counts(t, 10), GRID, NUMBERS), ["fold", "setting", "feature", "cut"])


@query(
    "m8_split_grid",
    f"""{_sql_tree_scores(3, GRID)}, told AS (SELECT unnest({list(range(len(GRID)))}) AS setting, unnest({[s.impurity for s in GRID]}) AS impurity,
          unnest([{', '.join(f'{float(s.least_share)!r}e0' for s in GRID)}]) AS least_share)
        SELECT setting, impurity, {sql_r4('least_share')} AS least_share, {sql_r4('a')} AS accuracy,
          CAST(row_number() OVER (ORDER BY floor(a * {_G} + {_S}) DESC, setting) AS INT) AS place
        FROM (SELECT setting, avg(accuracy) AS a FROM scores GROUP BY setting) m JOIN told USING (setting)""",
)
def _(t):
    return rounded(binned.search_splits(_counts(t, 3), GRID, NUMBERS), ["setting", "impurity", "place"])


@query(
    "m12_split_curve",
    f"""{_sql_tree_scores(10, [SplitSetting("gini", s) for s in SHARES])}
        SELECT {sql_r4('value')} AS value, {sql_r4('avg(train_auc)')} AS train_score, {sql_r4('avg(roc_auc)')} AS valid_score
        FROM scores JOIN (SELECT unnest({list(range(len(SHARES)))}) AS setting, unnest([{', '.join(f'{s!r}e0' for s in SHARES)}]) AS value) v USING (setting) GROUP BY value""",
)
def _(t):
    return rounded(binned.split_curve(_counts(t, 10), SHARES, NUMBERS), [])


@query(
    "m11_split_importance",
    f"""{_sql_trees(0, GRID[:1])}
        SELECT feature, {sql_r4('gain / sum(gain) OVER ()')} AS value FROM (SELECT feature, max(gain) AS gain FROM tried WHERE h = -1 AND place >= 0 GROUP BY feature) g""",
)
def _(t):
    return rounded(binned.split_importance(_counts(t, 0), NUMBERS, GRID[0]), ["feature"])


@query(
    "m7_card_cv",
    f"""{_sql_points(10)}, areas AS ({_sql_auc('SELECT * FROM pointed WHERE h = fold', 'h')})
        SELECT h AS fold, {sql_r4('any_value(auc)')} AS roc_auc, {sql_r4('avg(CASE WHEN (s > 0) = (y = 1) THEN 1e0 ELSE 0e0 END)')} AS accuracy,
          {sql_r4('coalesce(2e0 * count(*) FILTER (WHERE s > 0 AND y = 1) / nullif(count(*) FILTER (WHERE s > 0) + sum(y), 0), 0)')} AS f1
        FROM pointed JOIN areas USING (h) WHERE h = fold GROUP BY h""",
)
def _(t):
    rows = _rows(t, 10)
    cards = binned.fit_cards(binned.count_bins(rows, "TARGET", 10))
    return rounded(binned.cross_validate_card(rows, cards, "TARGET"), ["fold"])


def _sql_base(select: str) -> str:
    """``both``: tree and card scores of every row under the models of all rows."""
    cards = _sql_points(0)[len(_sql_long(0)):]
    return f"""{_sql_trees(0, GRID[:1])}{cards},
        both_scores AS (SELECT l.SK_ID_CURR, l.TARGET, CASE WHEN t.place < 0 OR bin <= cut THEN sl ELSE sr END AS a, 1 / (1 + exp(-c.s / 1000e0)) AS b
          FROM trees t JOIN long l ON l.place = greatest(t.place, 0) JOIN pointed c ON c.SK_ID_CURR = l.SK_ID_CURR AND c.h = -1 WHERE t.h = -1) {select}"""


def _base(t):
    rows = _rows(t, 0)
    return binned.base_scores(rows, binned.count_bins(rows, "TARGET"), NUMBERS, GRID[0])


@query("m5_binned_models", _sql_base(f"SELECT SK_ID_CURR, TARGET, {sql_r4('a')} AS score_split, {sql_r4('b')} AS score_card FROM both_scores"))
def _(t):
    return rounded(_base(t), ["SK_ID_CURR", "TARGET"])


@query("m9_binned_vote", _sql_base(f"SELECT SK_ID_CURR, TARGET, {sql_r4('(a + b) / 2')} AS score, CAST((a + b) / 2 > 0.5 AS INT) AS prediction FROM both_scores"))
def _(t):
    voted = model.vote(_base(t), ["score_split", "score_card"])
    return voted.select("SK_ID_CURR", "TARGET", r4("score").alias("score"), "prediction")
