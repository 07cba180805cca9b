import random

import public_tokenizers
import pytest
from awkward_rows import ROWS
from tokenizers import Tokenizer

from dragline.llm import token_count

FILE = public_tokenizers.path("word_bpe_49k.json")
PIECES = [
    "'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'", "''", "'r", "'v", "a", "b", "S", "Σ", "ΑΣ", "é", "é", "́", "İ",
    "ﬀ", "ß", "1", "٣", "²", "漢", "字", " ", "  ", " ", " ", "\x1c", "\x85", "​", "\n", "\t", "!", "...", "😀",
    "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "th", "ing", "tion", "क्षि", "Ⅷ", "ǅ", "ª", "_", "Å", "K",
]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(FILE)
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_counts_as_the_library(library):
    counter = token_count.TokenCounter(open(FILE, encoding="utf-8").read())
    rnd = random.Random(2)
    texts = ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 40))) for _ in range(4000)]
    texts += ["a" * n for n in range(60)] + ["'" * 2000 + "s", "ab" * 3000, "x" * 40_000]
    assert counter.count(texts).tolist() == library(texts)


def test_scan_composes_chunks_as_one_run():
    splitter, rnd = token_count.Splitter(), random.Random(4)
    text = "".join(rnd.choice(PIECES) for _ in range(5000))
    data = token_count.np.frombuffer(text.encode(), token_count.np.uint8)
    classes = splitter.classes(text, data)
    state, want = 0, []
    for c in classes:
        want.append(bool(splitter.starts[state, c]))
        state = splitter.next[state, c]
    assert len(data) > 3 * token_count.CHUNK and splitter.word_starts(classes).tolist() == want


def test_table_start_anew(library, monkeypatch):
    monkeypatch.setattr(token_count, "_MAX_STATES", 10)
    counter = token_count.TokenCounter(open(FILE, encoding="utf-8").read())
    texts = ["some words here", "other words there", "and more of them"] * 3
    assert [int(counter.count([t])[0]) for t in texts] == library(texts)


def test_awkward_rows(awkward, nothing, library):
    want = sorted(zip((str(i) for i, _ in ROWS), (len((t or "").encode()) for _, t in ROWS),
                      library([t or "" for _, t in ROWS]), strict=True))
    rows = token_count.count_tokens(awkward, FILE, limit=100).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in rows)
    assert token_count.count_tokens(nothing, FILE).count() == 0
