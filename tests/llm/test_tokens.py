import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loanloom.llm import tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def vocabulary():
    return tokens.load_vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def counted(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_documents_as_the_library_counts_them(vocabulary, library):
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()
    assert tokens.TokenCounter(vocabulary).counts(texts) == counted(library, texts)


ODD = st.text(st.sampled_from(list("ab's'll re\u03a3\u00df\u0130I\x1c\x1d\x85\xa0e\u0301\u00b2\u2167\u0663 12_-!?\u3000\u200b\u65e5\u672caaa<|>")), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD | st.sampled_from(["<|endoftext|>", "<|startoftext|>a", "aaaaaaa", ""]), max_size=6).map("".join))
def test_odd_texts(text):
    library, vocabulary = Tokenizer.from_file(PATH), test_odd_texts.vocabulary
    assert tokens.TokenCounter(vocabulary).counts([text]) == counted(library, [text])


test_odd_texts.vocabulary = tokens.load_vocabulary(PATH)


def test_overlapping_pairs_merge_from_the_left(vocabulary):
    """Merging all lowest-ranked pairs at once equals merging one pair at a time."""
    pairs = dict(zip(vocabulary.pairs.tolist(), zip(vocabulary.ranks.tolist(), vocabulary.merged.tolist())))

    def one_by_one(word):
        symbols = [int(vocabulary.inner[b]) for b in word[:-1]] + [int(vocabulary.final[word[-1]])]
        while True:
            found = [(pairs[a * vocabulary.size + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a * vocabulary.size + b in pairs]
            if not found:
                return len(symbols)
            (_, merged), i = min(found)
            symbols[i : i + 2] = [merged]

    words = [b"a" * n for n in range(1, 40)] + [b"banana" * 5, b"mississippi", "\u00e9\u00e9\u00e9".encode()]
    assert tokens.surviving_symbols(words, vocabulary).tolist() == [one_by_one(w) for w in words]


def test_odd_rows(odd_docs, no_docs, vocabulary, library):
    got = tokens.token_counts(odd_docs, vocabulary, limit=10).collect()
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    assert len(got) == 8
    for r in got:
        assert (r.n_bytes, r.n_tokens) == (len(texts[r.doc_id].encode()), counted(library, [texts[r.doc_id]])[0])
        assert r.over_limit == (r.n_tokens > 10)
    assert tokens.token_counts(no_docs, vocabulary).collect() == []
