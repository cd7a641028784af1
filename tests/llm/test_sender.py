"""What a task of op10 holds before it sends."""

import numpy as np

from mercantile.llm import substring_dedup as sd


def test_strings_of_hot_anchors_are_sent_early():
    out, rows = sd.Sender(None, sd.FLUSH_STRINGS), np.arange(sd.FLUSH_STRINGS // 2)
    assert list(out.add(rows, rows, rows, rows)) == []
    assert sum(len(b) for b in out.add(rows, rows, rows, rows)) > 0 and out.size == 0
