"""A step of operator 12's training, and scores where outputs are steep."""

import tracemalloc

import numpy as np

from roadveil.llm import attention
from test_lm import plain_model


def steep(factor):
    rng = np.random.default_rng(4)
    model = attention.Attention(rng.normal(0, 1, (attention.SYMBOLS, attention.CLASSES)))
    model.params[:] = rng.normal(0, 0.3, attention.SIZE)
    model.out[:] *= factor
    classes = rng.integers(0, attention.CLASSES, 400)
    return model, classes, np.where(rng.random(400) < 0.5, rng.integers(0, attention.KNOWN, 400), attention.KNOWN + classes)


def test_scores_are_the_models_however_steep_its_outputs():
    for factor in (8, 60):  # a hidden layer within a bound, and exponentials beyond a float's range
        model, classes, symbols = steep(factor)
        want = plain_model(model, classes, symbols)
        assert np.allclose(model.log_probs(classes, symbols, np.array([400])), want, rtol=1e-4, atol=1e-3)
        inputs, last, targets, begin, _ = attention.windows(classes, symbols, np.array([400]))
        b = begin[:, None]
        _, loss = model.gradient(inputs[b + np.arange(attention.SPAN)], *(x[b + np.arange(attention.CONTEXT, attention.SPAN)] for x in (last, targets)))
        assert abs(loss + want.mean()) < 1e-3 * abs(want.mean())


def test_a_step_holds_few_tables_of_its_tokens_by_class():
    """Outputs of a bounded number of tokens at once, and sums by class without a table of ones: most of a step's time went there."""
    rng = np.random.default_rng(5)
    model = attention.Attention(rng.normal(0, 1, (attention.SYMBOLS, attention.CLASSES)))
    seen = rng.integers(0, attention.CLASSES, (attention.BATCH, attention.SPAN))
    symbols, targets = (rng.integers(0, attention.CLASSES, (attention.BATCH, attention.STRIDE)) for _ in range(2))
    model.gradient(seen, symbols, targets)
    tracemalloc.start()
    model.gradient(seen, symbols, targets)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4 * (attention.BATCH * attention.STRIDE * attention.CLASSES * 4)
