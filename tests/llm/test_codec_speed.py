"""What the encoder remembers is not asked for again."""

from vitalgrid.llm import piece_codec
from vitalgrid.llm.queries import vocabulary


def test_a_pair_of_pieces_is_merged_once(monkeypatch):
    c = piece_codec.Codec(piece_codec.read_model(vocabulary("piece_bpe_32k.model")))
    asked, real = [], c.together
    monkeypatch.setattr(c, "together", lambda a, b: asked.append((a, b)) or real(a, b))
    text = "Internationalisierungsfragen xqzv" * 3
    first = c.encode(text)
    c.clear()
    assert c.encode(text) == first and len(asked) == len(set(asked)) > 5
