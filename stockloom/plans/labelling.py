"""Label items through a pluggable text model."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from stockloom.functions.text import parse_label_response, prompt_line

# A text model: takes a prompt, returns the answer.
Classifier = Callable[[str], str]

TEMPLATE = (
    "Assign one short subcategory to each product below, judging by its number, category and description.\n"
    "Answer with a JSON object that maps each item number to its subcategory and nothing else.\n"
    "{lines}"
)


def echo_classifier(prompt: str) -> str:
    """Returns the prompt; for tests of the flow."""
    return prompt


CLASSIFIERS: dict[str, Classifier] = {"mock": echo_classifier}


def classifier(name: str) -> Classifier:
    """Model registered under a name, in any case."""
    try:
        return CLASSIFIERS[name.lower()]
    except KeyError:
        raise ValueError(f"Unsupported model '{name}'") from None


def label_items(df, classify: Classifier, columns, key, label="segment", batch_size=10, template=TEMPLATE, parallelism=None):
    """Items with their columns and the label the model gave; NULL when the answer lacks the item or cannot be read.

    Every item carries its columns through the prompt step, so no join back is needed. Batches are cut from the rows of a
    partition; `parallelism` sets how many partitions, and so model calls, run side by side. An answer is parsed once for its batch.
    """
    kept = [key, *columns]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answers(rows):
            """Batches of a table as lists, each with its answer."""
            lines = rows["_line"].to_pylist()
            cuts = list(range(0, len(lines), batch_size))
            texts = [classify(template.format(lines="\n".join(lines[at : at + batch_size]))) for at in cuts]
            items = pa.ListArray.from_arrays(pa.array([*cuts, len(lines)], pa.int32()), rows["_item"].combine_chunks())
            return pa.RecordBatch.from_arrays([items, pa.array(texts, pa.string())], names=["_items", "_response"])

        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            full = len(held) // batch_size * batch_size
            if full:
                yield answers(held.slice(0, full))
                held = held.slice(full)
        if held is not None and len(held):
            yield answers(held)

    if parallelism is not None:
        df = df.repartition(parallelism, key)
    item = F.struct(*kept)
    lines = df.select(item.alias("_item"), prompt_line(key, columns).alias("_line"))
    schema = df.select(F.array(item).alias("_items"), F.lit("").alias("_response")).schema
    labels = parse_label_response(F.col("_response")).alias("_labels")
    answered = lines.mapInArrow(ask, schema).select("_items", labels).select(F.explode("_items").alias("_item"), "_labels")
    return answered.select("_item.*", F.try_element_at("_labels", F.col(f"_item.`{key}`").cast("string")).alias(label))
