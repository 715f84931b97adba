"""A worker's tables are those of the very model that a task was given."""

import pickle

import public_tokenizers

from inkstone.llm.piece_bpe import Pieces


def test_models_that_differ_in_ranks_or_merges_do_not_share_tables():
    pieces = Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    same = pieces.__reduce__()[1][0]
    assert same == pieces.__reduce__()[1][0]
    texts = ["▁the▁quick▁brown▁fox", "▁internationalisation"]
    want = [pieces.encode_marked(t) for t in texts]
    assert [pickle.loads(pickle.dumps(pieces)).encode_marked(t) for t in texts] == want
    for change in ("rank", "merged", "halves"):
        other = Pieces(public_tokenizers.path("piece_bpe_32k.model"))
        state = getattr(other, change)
        if isinstance(state, dict):
            state.pop(next(iter(state)))
        else:
            setattr(other, change, list(reversed(list(state))))
        assert other.__reduce__()[1][0] != same
    assert [pickle.loads(pickle.dumps(pieces)).encode_marked(t) for t in texts] == want
