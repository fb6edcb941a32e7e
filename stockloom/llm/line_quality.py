"""Quality rules and line labelling by a linear-chain conditional random field.

A text's lines with a word form a chain; each is labelled content (0) or boilerplate (1) by Viterbi decoding. The field's weights are
fitted on a bounded sample of documents labelled good or bad, whose lines take the document's label. A text is kept if it passes the
base rules and enough of its words stand on content lines.

Null and empty texts have no words and fail the base rules. Without labels of both kinds no field is fitted and the base rules decide
alone. Repeated rows are judged one by one, and of one id one text is fitted on, the least; an id with both labels is not. The text's
length is not limited.
An empty table gives no rows. Other columns stay as they are, whatever their names.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stockloom.llm.wording import as_bytes, packed, spaced_words

#: Labelled documents of each kind, and lines of one document, that the field is fitted on at most.
SAMPLE_DOCS, SAMPLE_LINES = 500, 200
#: Base rules: fewest words, and the largest share of words in repeated windows of five, in hundredths.
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5
CONTENT_SHARE = 0.5

SYMBOLS = b"#*$%&|<>"
_SPACE, _LOWER, _UPPER, _DIGIT, _SYMBOL, _MARK, _BANG, _LEAD, _TAIL, _OTHER = range(10)


def _class_of(b):
    if b in b" \t\n\x0b\x0c\r":
        return _SPACE
    if 97 <= b <= 122:
        return _LOWER
    if 65 <= b <= 90:
        return _UPPER
    if 48 <= b <= 57:
        return _DIGIT
    if b in SYMBOLS:
        return _SYMBOL
    if b in b".,;:?'\"()-":
        return _MARK
    if b == 33:
        return _BANG
    if b >= 128:
        return _TAIL if b < 192 else _LEAD
    return _OTHER


CLASSES = np.array([_class_of(b) for b in range(256)], np.intp)
FEATURES = ["bias", "length", "upper", "symbols", "digits", "marks", "word_length", "repeated_words", "repeated_line", "bangs", "other_letters"]


def repeated_words(words, size=WINDOW):
    """How many words lie in windows of `size` words that stand twice or more in the text."""
    if len(words) <= size:
        return 0
    known = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    count = len(words) - size + 1
    keys, room = ids[:count], len(known)
    for k in range(1, size):
        if room * len(known) >= 2**62:  # renumber, so that the keys stay exact
            keys = np.unique(keys, return_inverse=True)[1].astype(np.int64)
            room = int(keys.max()) + 1
        keys = keys * len(known) + ids[k : k + count]
        room *= len(known)
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    again = np.isin(keys, twice)
    covered = np.zeros(len(words), bool)
    for k in range(size):
        covered[k : k + count] |= again
    return int(covered.sum())


def measures(text):
    """Base counts of a text, and for its lines with a word the feature rows and numbers of words."""
    text = text or b""
    words = spaced_words(text)
    lines = text.split(b"\n")
    classes = CLASSES[np.frombuffer(text, np.uint8)]
    line_of = np.zeros(len(text), np.intp)
    np.cumsum(np.frombuffer(text, np.uint8)[:-1] == 10, out=line_of[1:])
    counts = np.bincount(line_of * 10 + classes, minlength=10 * len(lines)).reshape(-1, 10)
    seen, in_line, distinct, again = set(), [], [], []
    for line in lines:
        own = line.split()
        in_line.append(len(own))
        distinct.append(len(set(own)))
        again.append(bool(own) and line in seen)
        seen.add(line)
    total = counts.sum(axis=0)
    base = {
        "n_words": len(words),
        "word_chars": int(len(text) - total[_SPACE] - total[_TAIL]),
        "n_symbols": int(total[_SYMBOL]),
        "n_dup_lines": sum(again),
        "n_repeat_words": repeated_words(words),
    }
    n = np.array(in_line)
    full = n > 0
    n, counts = n[full], counts[full].astype(float)
    chars = counts.sum(axis=1) - counts[:, _SPACE] - counts[:, _TAIL]
    per_word = lambda k: np.minimum(counts[:, k] / n, 1)
    rows = np.column_stack(
        [
            np.ones(len(n)),
            np.log1p(n) / 5,
            counts[:, _UPPER] / np.maximum(counts[:, _UPPER] + counts[:, _LOWER], 1),
            per_word(_SYMBOL),
            counts[:, _DIGIT] / chars,
            per_word(_MARK),
            np.minimum(chars / n / 10, 2),
            1 - np.array(distinct)[full] / n,
            np.array(again, float)[full],
            per_word(_BANG),
            counts[:, _LEAD] / chars,
        ]
    )
    return base, rows, n


def viterbi(scores, trans):
    """The best labels of a chain. scores: of label 1 against label 0 per line; trans[a][b]: of b after a."""
    (t00, t01), (t10, t11) = trans
    zero, one, back = 0.0, scores[0], []
    for score in scores[1:]:
        from_one = (zero + t00 < one + t10, zero + t01 < one + t11)
        zero, one = (one + t10 if from_one[0] else zero + t00), (one + t11 if from_one[1] else zero + t01) + score
        back.append(from_one)
    label = int(one > zero)
    labels = [label]
    for from_one in reversed(back):
        label = int(from_one[label])
        labels.append(label)
    return labels[::-1]


def _chains(sample):
    """Chains as one padded block: features, labels, mask."""
    longest = max(len(rows) for rows, _ in sample)
    x = np.zeros((len(sample), longest, len(FEATURES)))
    y, mask = np.zeros((len(sample), longest), int), np.zeros((len(sample), longest), bool)
    for k, (rows, label) in enumerate(sample):
        x[k, : len(rows)], y[k, : len(rows)], mask[k, : len(rows)] = rows, label, True
    return x, y, mask


def _marginals(scores, trans, mask):
    """Log partition, label probabilities and expected transitions of all chains, by forward and backward sums."""
    chains, longest = scores.shape
    node = np.stack([np.zeros_like(scores), scores], axis=2)
    forward, backward = np.zeros((chains, longest, 2)), np.zeros((chains, longest, 2))
    forward[:, 0] = node[:, 0]
    for t in range(1, longest):
        step = forward[:, t - 1, :, None] + trans
        forward[:, t] = np.where(mask[:, t, None], np.logaddexp(step[:, 0], step[:, 1]) + node[:, t], forward[:, t - 1])
    logz = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
    pairs = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        step = trans + (node[:, t + 1] + backward[:, t + 1])[:, None, :]
        here = mask[:, t + 1]
        backward[:, t] = np.where(here[:, None], np.logaddexp(step[:, :, 0], step[:, :, 1]), 0)
        joint = np.exp(forward[:, t, :, None] + step - logz[:, None, None])
        pairs += joint[here].sum(axis=0)
    one = np.exp(forward[..., 1] + backward[..., 1] - logz[:, None]) * mask
    return logz, one, pairs


def fit(sample, rounds=150, rate=0.1, penalty=1e-3):
    """Weights and transitions with the greatest penalised likelihood of the labelled chains, by Adam steps over all of them.
    sample: (feature rows, label) per document; None unless both labels occur."""
    sample = [(rows, label) for rows, label in sample if len(rows)]
    if len({label for _, label in sample}) < 2:
        return None
    x, y, mask = _chains(sample)
    lines = mask.sum()
    seen_pairs = np.zeros((2, 2))
    np.add.at(seen_pairs, (y[:, :-1][mask[:, 1:]], y[:, 1:][mask[:, 1:]]), 1)
    theta = np.zeros(len(FEATURES) + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        weight, trans = theta[: len(FEATURES)], theta[len(FEATURES) :].reshape(2, 2)
        _, one, pairs = _marginals(x @ weight, trans, mask)
        slope = np.concatenate([((y - one) * mask).ravel() @ x.reshape(-1, len(FEATURES)), (seen_pairs - pairs).ravel()]) / lines - penalty * theta
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        theta = theta + rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
    return theta[: len(FEATURES)], theta[len(FEATURES) :].reshape(2, 2).tolist()


def content_words(rows, sizes, model):
    """Words on lines labelled content."""
    if model is None or not len(rows):
        return int(sizes.sum())
    weight, trans = model
    labels = viterbi((rows @ weight).tolist(), trans)
    return int(sizes[np.array(labels) == 0].sum())


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judged(model=None):
    """Column function text -> base counts and words on content lines."""
    names = [*BASE, "content_words"]

    def judge(texts: pa.Array) -> pa.Array:
        out = []
        for text in as_bytes(texts):
            base, rows, sizes = measures(text)
            out.append(base | {"content_words": content_words(rows, sizes, model)})
        return pa.array(out, pa.struct([(n, pa.int64()) for n in names]))

    return F.arrow_udf(judge, ", ".join(f"{n} long" for n in names)).asNondeterministic()


def _features():
    """Column function text -> feature rows of its lines, end to end."""

    def of(texts: pa.Array) -> pa.Array:
        out = []
        for text in as_bytes(texts):
            _, rows, _ = measures(text)
            out.append(rows.ravel().tolist() if len(rows) <= SAMPLE_LINES else [])
        return pa.array(out, pa.list_(pa.float64()))

    return F.arrow_udf(of, "array<double>")


def fitted(docs, labels, doc_id="doc_id", text="text", label="quality", sample=SAMPLE_DOCS):
    """The field, from at most `sample` labelled documents of each kind (least hashes of the id), texts of up to SAMPLE_LINES lines."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id"))
    known = known.agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("other")).where("label = other").drop("other")
    by_hash = [F.xxhash64("id"), "id"]
    chosen = known.where("label = 0").orderBy(*by_hash).limit(sample).union(known.where("label = 1").orderBy(*by_hash).limit(sample))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.groupBy("id", "label").agg(F.min("text").alias("text"))
    rows = rows.select("id", "label", _features()("text").alias("rows")).collect()
    rows.sort(key=lambda r: (str(r["id"]), r["label"], r["rows"]))
    return fit([(np.array(r["rows"]).reshape(-1, len(FEATURES)), 1 - r["label"]) for r in rows])


def verdicts(found, share=CONTENT_SHARE):
    """base_failed and kept, from the struct column `found`."""
    n, repeated, content = (F.col(f"{found}.{c}") for c in ("n_words", "n_repeat_words", "content_words"))
    failed = (n < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n)
    return failed, ~failed & (content >= math.ceil(share * 100) / 100 * n)


def report(docs, labels, doc_id="doc_id", text="text", share=CONTENT_SHARE, **options):
    """One row per document: base counts, words on content lines, base_failed and kept."""
    model = fitted(docs, labels, doc_id=doc_id, text=text, **options)
    rows = docs.select(F.col(doc_id).alias("doc_id"), judged(model)(text).alias("found"))
    failed, kept = verdicts("found", share)
    return rows.select("doc_id", *[F.col(f"found.{c}").alias(c) for c in BASE], failed.alias("base_failed"), kept.alias("kept"), F.col("found.content_words").alias("content_words"))


def retained(docs, model, text="text", share=CONTENT_SHARE):
    """The rows of docs that are kept, columns unchanged."""
    rows = packed(docs, text=text).select("row", judged(model)("text").alias("found"))
    return rows.where(verdicts("found", share)[1]).select("row.*")
