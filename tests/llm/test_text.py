import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from grainmill.llm import kneser_ney, quality_rules
from grainmill.llm.text import PRIME, SpanHasher, _BASES, _BYTE_CODES, chunks, mix
from tests.llm import cases as C

SIZES = [512, 1024, 2048]


@given(st.binary(max_size=300), st.integers(0, 300), st.integers(0, 300))
def test_span_hash_is_its_polynomials(data, i, j):
    i, j = sorted((min(i, len(data)), min(j, len(data))))
    value = [sum(int(_BYTE_CODES[k][c]) * pow(_BASES[k], at, PRIME) for at, c in enumerate(data[i:j])) % PRIME for k in (0, 1)]
    want = mix(np.array([((value[0] << 31 | value[1]) + (j - i) * 0xD6E8FEB86659FD93) % 2**64], np.uint64))
    assert SpanHasher(np.frombuffer(data, np.uint8))(np.array([i]), np.array([j])) == want


def test_remainders_hold_for_long_arrays():
    data = np.full(1 << 21, 255, np.uint8)
    found = SpanHasher(data)(np.array([0, 1 << 20, 5]), np.array([1 << 20, 1 << 21, 5 + (1 << 20)]))
    assert len({*found.tolist()}) == 1


@pytest.mark.parametrize("n", SIZES)
def test_swapped_letters_are_different_lines_words_and_windows(n):
    one, other = C.thue_morse(n), C.thue_morse(n, "ba")
    texts = [f"{one}\n{other}", f"{one} v w x y zz {other} v w x y", f"{one} v w x y {one} v w x y"]
    for text in texts:
        (chunk,) = chunks(pa.array([text]))
        found = quality_rules.measure(chunk, quality_rules.RepetitionRules())
        assert (found["n_words"][0], found["word_chars"][0], found["n_symbols"][0], found["n_dup_lines"][0], found["n_repeat_words"][0]) == C.repetition(text)
    (chunk,) = chunks(pa.array([f"{one} {other} {one}"]))
    first, second, third = kneser_ney.folded_words(chunk)[1].tolist()
    assert first == third != second
