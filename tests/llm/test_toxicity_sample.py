"""What the toxicity training sample sends to the driver."""

import numpy as np

from hourpanel.llm import toxicity
from hourpanel.llm.subwords import word_features

TEXTS = ["", "one two, two THREE", "İstanbul muslims été 12", "three one " * 50]


def test_bags_equal_features_of_every_word():
    bags = toxicity.Bags(map(toxicity.distinct_words, TEXTS), toxicity.Vocabulary())
    for i, text in enumerate(TEXTS):
        words = [word_features(w) for w in sorted(set(toxicity._WORD(text.lower())))]
        at, sizes = bags[i]
        assert at.tolist() == [b for bs in words for b in bs] and sizes.tolist() == [len(bs) for bs in words]
        again = toxicity.features(text)
        assert at.dtype == again[0].dtype == np.int32 and (at == again[0]).all() and (sizes == again[1]).all()


def test_sample_sends_words_and_no_features(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"doc_id": i, "y": 0, "text": t} for i, t in enumerate(TEXTS)])
    (sent,) = toxicity._word_rows(iter([batch]))
    assert sent.column("words").to_pylist() == ["", "one three two", toxicity.distinct_words(TEXTS[2]), "one three"]
    assert sent.nbytes < 400
