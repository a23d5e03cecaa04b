"""Helpers of the training-data operators over generated texts."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from loadscape.llm import chat, linededup, quality, simhash
from test_simhash import plain_fingerprint

TEXT = st.text(st.sampled_from(list("ab #\\<>/turn:\n\t\x0b\x0c\r é\U0001f600AZ \x1c")), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), min_size=1, max_size=6))
def test_assembled_turns_read_back(turns):
    roles, texts = (pa.array([t.encode() for t in c], pa.large_binary()) for c in zip(*turns))
    out, starts, at, n = chat.assemble(roles, texts)
    data = out.tobytes()
    assert chat.turns_of(data) == [(r.encode(), t.encode()) for r, t in turns]
    for i, (_, text) in enumerate(turns):
        content = data[at[i] : at[i] + n[i]]
        assert chat.unescape(content) == text.encode() and b"###" not in content and b"</turn>" not in content
    assert starts[-1] == len(data)


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_keys_words_and_prints(text):
    lines, keys = linededup.line_keys(text.encode(), 5)
    want = [re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x) for x in text.split("\n")]
    want = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in want]
    assert [k and k.decode() for k in keys] == [x if len(x) >= 5 else None for x in want] and [x.decode() for x in lines] == text.split("\n")
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)
    counts = quality.byte_counts(pa.array([text.encode(), b"", text.encode()], pa.large_binary()))
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    assert [int(v[2]) for v in counts.values()] == [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text))]
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    assert quality.repeated_words(text.encode()) == len({k + d for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for d in range(5)})


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=40), st.integers(1, 4))
def test_merged_filters_let_repeats_pass(hashes, parts):
    """Whatever is seen in two parts, or twice in one, passes the merged twice-filter."""
    words = 1 << 8
    pair = np.zeros((2, words), np.uint64)
    dealt = [hashes[k::parts] for k in range(parts)]
    for part in dealt:
        once, twice = np.zeros(words, np.uint64), np.zeros(words, np.uint64)
        word, mask = linededup._bits(np.array(part, np.uint64), words)
        for w, m in zip(word, mask):
            if once[w] & m == m:
                twice[w] |= m
            once[w] |= m
        pair[1] |= twice | (pair[0] & once)
        pair[0] |= once
    again = [h for h, n in Counter(hashes).items() if n > 1]
    if again:
        word, mask = linededup._bits(np.array(again, np.uint64), words)
        assert (pair[1][word] & mask == mask).all()
