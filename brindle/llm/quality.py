"""Quality classifier: a sparse ensemble of rules over statistics of a text, run as column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import fresh

#: At most so many labelled rows are learned from, those with the least hash of their id.
MOST_LABELLED = 20_000


def counts(text: Column) -> Column:
    """What is counted in a whole text, each once: a struct of doubles."""
    whole = F.coalesce(text, F.lit(""))

    def count(pattern: str) -> Column:
        return F.regexp_count(whole, F.lit(pattern)).cast("double")

    def single(sign: str) -> Column:
        return (F.length(whole) - F.length(F.replace(whole, F.lit(sign), F.lit("")))).cast("double")

    found = {
        "chars": F.length(whole).cast("double"), "words": count(r"\S+"), "letters": count(r"\p{L}+"), "lines": single("\n"), "capitals": count(r"\p{Lu}"), "capital_words": count(r"(?<!\p{L})\p{Lu}{2,}(?!\p{L})"),
        "digits": count(r"[0-9]+"), "signs": count(r"[#$%&*@\\^_~<>{}=+]"), "sign_runs": count(r"[^\p{L}\p{N}\s]{2,}"), "bars": single("|"), "shouts": single("!"), "sentence_ends": count(r"[.?!](?:\s|$)"),
        "repeated": count(r"(?<!\S)(\S+)\s+\1(?!\S)"), "long_words": count(r"\S{25,}"),
    }
    return F.struct(*(c.alias(n) for n, c in found.items()))


def statistics(found: Column) -> dict[str, Column]:
    """Numbers that tell a text's form, without its topic or language, from its counts."""
    one = F.lit(1.0)
    words, letters = F.greatest(found["words"], one), F.greatest(found["letters"], one)
    return {
        "log_chars": F.log1p(found["chars"]),
        "chars_per_word": found["chars"] / words,
        "words_per_line": words / (found["lines"] + 1),
        "letter_runs_per_word": found["letters"] / words,
        "capitals_per_letter_run": found["capitals"] / letters,
        "capital_words": found["capital_words"] / words,
        "digit_runs_per_word": found["digits"] / words,
        "signs_per_word": found["signs"] / words,
        "sign_runs": found["sign_runs"] / words,
        "bars_per_word": found["bars"] / words,
        "shouts_per_word": found["shouts"] / words,
        "sentence_ends": found["sentence_ends"] / words,
        "repeated_words": found["repeated"] / words,
        "long_words": found["long_words"] / words,
    }


Rule = tuple[tuple[int, float, float], ...]  # (feature, above, up to) in a row; all have to hold


@dataclass
class RuleModel:
    """Score: the logistic function of intercept plus the weights of the rules that hold."""

    names: list[str]
    intercept: float
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def score(self, columns: dict[str, Column]) -> Column:
        """The score as an expression over columns that hold the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for feature, low, high in rule:
                value = columns[self.names[feature]]
                if np.isfinite(low):
                    holds = holds & (value > low)
                if np.isfinite(high):
                    holds = holds & (value <= high)
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total += weight * holds(rule, x)
        return 1 / (1 + np.exp(-total))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for feature, low, high in rule:
        out &= (x[:, feature] > low) & (x[:, feature] <= high)
    return out


def _narrowed(rule: Rule, feature: int, low: float, high: float) -> Rule:
    bounds = {f: (a, b) for f, a, b in rule}
    a, b = bounds.get(feature, (-np.inf, np.inf))
    bounds[feature] = (max(a, low), min(b, high))
    return tuple((f, *bounds[f]) for f in sorted(bounds))


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3, least: int = 10, cuts: int = 48) -> list[Rule]:
    """The conjunctions along all paths of boosted trees: one rule for each node but the roots."""
    grids = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, cuts + 1)[1:-1])) for f in range(x.shape[1])]
    # values halfway to the next one seen, so that a split isn't on a value itself
    for f, grid in enumerate(grids):
        values = np.unique(x[:, f])
        after = np.searchsorted(values, grid, "right")
        grids[f] = np.unique([(values[a - 1] + values[a]) / 2 for a in after if 0 < a < len(values)])
    coded = np.stack([np.searchsorted(g, x[:, f], "left") for f, g in enumerate(grids)], 1) if len(x) else np.empty((0, x.shape[1]), int)
    score, rules = np.zeros(len(x)), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        pull, weight = y - p, np.maximum(p * (1 - p), 1e-6)
        level: list[tuple[Rule, np.ndarray]] = [((), np.arange(len(x)))]
        leaves: list[np.ndarray] = []
        for _ in range(depth):
            following = []
            for rule, rows in level:
                best = (1e-6, None, None)
                g_all, h_all = pull[rows].sum(), weight[rows].sum()
                for f, grid in enumerate(grids):
                    if not len(grid):
                        continue
                    code = coded[rows, f]
                    g = np.cumsum(np.bincount(code, pull[rows], len(grid) + 1))[:-1]
                    h = np.cumsum(np.bincount(code, weight[rows], len(grid) + 1))[:-1]
                    n = np.cumsum(np.bincount(code, minlength=len(grid) + 1))[:-1]
                    gain = g**2 / (h + 1) + (g_all - g) ** 2 / (h_all - h + 1) - g_all**2 / (h_all + 1)
                    gain[(n < least) | (len(rows) - n < least)] = -1
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (float(gain[k]), f, k)
                if best[1] is None:
                    leaves.append(rows)
                    continue
                _, f, k = best
                left = coded[rows, f] <= k
                for rule_, rows_ in ((_narrowed(rule, f, -np.inf, float(grids[f][k])), rows[left]), (_narrowed(rule, f, float(grids[f][k]), np.inf), rows[~left])):
                    rules[rule_] = None
                    following.append((rule_, rows_))
            level = following
        for rows in [*leaves, *(rows for _, rows in level)]:
            score[rows] += rate * pull[rows].sum() / (weight[rows].sum() + 1)
    return list(rules)


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 3000) -> tuple[float, np.ndarray]:
    """Intercept and weights that minimise the mean logistic loss plus penalty times the sum of absolute weights."""
    n, m = r.shape
    mean = r.mean(0)
    centred = r - mean
    step = 4 / (np.linalg.norm(centred, 2) ** 2 / n + 1)
    w, b = np.zeros(m), float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
    v, c, t = w.copy(), b, 1.0
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-(centred @ v + c))) - y
        w_new = v - step * (centred.T @ error) / n
        w_new = np.sign(w_new) * np.maximum(np.abs(w_new) - step * penalty, 0)
        b_new = c - step * error.mean()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w_new + (t - 1) / t_new * (w_new - w), b_new + (t - 1) / t_new * (b_new - b)
        done = max(np.abs(w_new - w).max(initial=0), abs(b_new - b)) < 1e-7
        w, b, t = w_new, b_new, t_new
        if done:
            break
    return float(b - mean @ w), w


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], penalty: float = 3e-4) -> RuleModel:
    """Rules from boosted trees, thinned out by the lasso. Without rows of both labels, the score is a constant."""
    if not len(y) or y.min() == y.max():
        mean = float(y.mean()) if len(y) else 0.5
        return RuleModel(names, float(np.log((mean + 0.01) / (1.01 - mean))))
    rules, columns, seen = [], [], set()
    for rule in tree_rules(x, y):
        column = holds(rule, x)
        key = column.tobytes()
        if key not in seen and column.any() and not column.all():
            seen.add(key)
            rules.append(rule)
            columns.append(column)
    if not rules:
        return RuleModel(names, float(np.log(y.mean() / (1 - y.mean()))))
    intercept, weights = lasso_logistic(np.stack(columns, 1).astype(float), y, penalty)
    kept = np.flatnonzero(weights)
    return RuleModel(names, intercept, [rules[k] for k in kept], [float(weights[k]) for k in kept])


def is_held_out(id_: Column) -> Column:
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST_LABELLED) -> RuleModel:
    """Learn from at most `most` labelled rows that aren't held out. Rows without a label or an id are passed over.

    The sample's ids and labels are bounded by `most`, so they are broadcast. The statistics of its texts come to
    the driver, of at most `most` rows too, those with the least hash, where documents repeat.
    """
    id_, label, found, draw = (fresh(docs, n) for n in ("_id", "_label", "_counts", "_draw"))
    known = labels.select(F.col(id_col).alias(id_), F.col(label_col).cast("double").alias(label)).filter(F.col(label).isNotNull() & F.col(id_).isNotNull() & ~is_held_out(F.col(id_)))
    sample = known.orderBy(F.xxhash64(id_), id_, label).limit(most)
    columns = statistics(F.col(found))
    joined = docs.join(F.broadcast(sample), docs[id_col] == sample[id_])
    # rows of a repeated document or label are as many as there are, so the joined ones are bounded too
    drawn = joined.select(F.col(text_col), label, F.xxhash64(id_col, text_col, label).alias(draw))
    drawn = drawn.select(F.explode(F.array(counts(F.col(text_col)))).alias(found), label, draw).select(*(c.alias(n) for n, c in columns.items()), label, draw)
    picked = drawn.orderBy(draw, label, *columns).limit(most).drop(draw)
    rows = np.array(picked.collect(), float).reshape(-1, len(columns) + 1)
    rows = rows[np.lexsort(rows.T)]  # the same sums whatever the order of rows
    return fit_rules(rows[:, :-1], rows[:, -1], list(columns))


def score_documents(docs: DataFrame, model: RuleModel, threshold: float = 0.3, text_col: str = "text", score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """Add score (0 to 1) and predicted (1 from threshold on) to each document.

    Narrow expressions over the whole text: no shuffle, no Python. Null texts score as empty ones. Rows, ids and
    other columns stay; columns called as the new ones are replaced. An empty table gives no rows.
    """
    plain = docs.drop(*(c for c in docs.columns if c.lower() in (score_col.lower(), predicted_col.lower())))
    if text_col not in plain.columns:
        raise ValueError("the new columns can't replace the text")
    held = fresh(plain, "_statistics")
    # a generator of one row: else the text would be counted anew for each rule, below a filter on the score at least
    measured = plain.select("*", F.explode(F.array(counts(F.col(text_col)))).alias(held))
    columns = statistics(F.col(held))
    score = model.score({n: columns[n] for n in model.names})
    return measured.withColumn(score_col, score).withColumn(predicted_col, (F.col(score_col) >= threshold).cast("int")).drop(held)
