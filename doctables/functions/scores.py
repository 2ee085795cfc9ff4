"""Class scores of one query. ``logits`` is an array column with one entry per class.

The class count is known from the label map, so the sums are written out per class: plain
arithmetic that whole-stage codegen compiles, instead of interpreted lambdas.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def _exponentials(logits: Column, n_classes: int) -> list[Column]:
    top = F.array_max(logits)
    return [F.exp(F.get(logits, F.lit(i)) - top) for i in range(n_classes)]


def softmax(logits: Column, n_classes: int) -> Column:
    terms = _exponentials(logits, n_classes)
    total = reduce(add, terms)
    return F.array(*[t / total for t in terms])


def best_score(logits: Column, n_classes: int) -> Column:
    """Probability of the best class. Its own term is exp(0) = 1."""
    return F.lit(1.0) / reduce(add, _exponentials(logits, n_classes))


def best_class(logits: Column) -> Column:
    """Id of the best class, the first one on ties."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def label_of(class_id: Column, labels: dict[int, str]) -> Column:
    """Name of a class id; null for an id outside the map, which callers tell as an error."""
    entries = [F.lit(x) for pair in sorted(labels.items()) for x in pair]
    return F.try_element_at(F.create_map(*entries), class_id)


def no_label(class_id: Column) -> Column:
    """The reason of an error row."""
    return F.concat(F.lit("no label for class id "), class_id.cast("string"))
