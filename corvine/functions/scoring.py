"""Score expressions: BM25, boosts, vectors, fusion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: BM25 parameters, boosts by kind, fusion weight.
K1, B = 1.5, 0.75
KIND_BOOST = {
    "Class": 2.0,
    "Interface": 2.0,
    "Enum": 2.0,
    "Method": 1.3,
    "Constructor": 1.3,
    "XmlNode": 1.2,
    "XmlNamespace": 1.1,
    "Field": 1.0,
    "Import": 0.4,
}
DEFINITIONS = ("Class", "Interface", "Enum")
CALLABLES = ("Method", "Constructor")
ALPHA = 0.5


def term_frequency(tokens: Column, term: Column) -> Column:
    return F.size(F.filter(tokens, lambda x: x == term))


def holds(content: Column, name: Column, term: Column) -> Column:
    """Whether a document counts for a term: as a part of the lower-cased content or name."""
    return F.contains(F.lower(content), term) | F.contains(F.lower(name), term)


def idf(n: Column, df: Column) -> Column:
    return F.greatest(F.log((n - df + 0.5) / (df + 0.5) + 1), F.lit(0.0))


def bm25_term(tf: Column, idf_: Column, length: Column, average: Column) -> Column:
    return idf_ * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * length / average))


def name_boost(name: Column, kind: Column, query: Column) -> Column:
    """By the raw lower-cased query: the name itself counts more than a name that contains it."""
    name, query = F.lower(name), F.lower(query)
    same = F.when(kind.isin(*DEFINITIONS), 5.0).when(kind.isin(*CALLABLES), 3.0).otherwise(2.0)
    part = F.when(kind.isin(*DEFINITIONS), 2.5).otherwise(1.5)
    return F.when(name == query, same).when(F.contains(name, query), part).otherwise(1.0)


def kind_boost(kind: Column) -> Column:
    out = F.lit(1.0)
    for k, v in KIND_BOOST.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision over the common length."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def rescale(cosine: Column) -> Column:
    return (cosine + 1) / 2


def min_max(score: Column, least: Column, most: Column) -> Column:
    """To [0, 1]; 1 if all are equal."""
    return F.when(most > least, (score - least) / (most - least)).otherwise(1.0)


def l2_normalise(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))
