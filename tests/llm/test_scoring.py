"""The traversal of all texts at once against the pass over each."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tablestore.llm import scoring


@pytest.mark.parametrize("learned", [0, 3, 60])
def test_all_passes_at_once(learned):
    draw = random.Random(1)
    texts = [" ".join(draw.choice("abcdefg") * draw.randrange(1, 3) for _ in range(draw.randrange(12))) for _ in range(60)]
    chunk = scoring.Chunk(pa.chunked_array([texts]), np.arange(60) < learned)
    chunk.find_triples()
    total, distinct = int(chunk.word_counts.sum()), int((chunk.word_counts > 0).sum())
    model = scoring.Automaton(chunk, chunk.word_counts, chunk.pair_counts, chunk.triple_counts, total, distinct, (3.0, 2.0))
    got = np.add.reduceat(model.traverse_all(chunk, chunk.pair_counts), chunk.begins)
    assert got == pytest.approx([model.traverse(chunk.word_at[b - n:b].tolist()) for b, n in zip(chunk.stops.tolist(), chunk.tokens.tolist())])
