"""What Python workers hold on to."""

import random

from tablelens.llm import common
from tablelens.llm.common import module_cache, released
from tablelens.llm.encoding import encoder_name, text_encoder
from tablelens.llm.queries import JSON


def test_an_encoder_remembers_no_more_pieces_than_told():
    dice = random.Random(3)
    texts = [" ".join("".join(dice.choices("abcdeinorst", k=7)) for _ in range(100)) for _ in range(60)]
    encoder = text_encoder(JSON, cached_pieces=300)
    for text in texts + texts:
        want = encoder.library.encode(text, add_special_tokens=False).ids
        assert encoder.encode([text])[0].tolist() == want
        assert len(encoder.known) + len(encoder.older) <= 2 * (300 + 100)
    assert text_encoder(JSON) is encoder and encoder.cached_pieces > 300
    common._CACHE.pop(encoder_name(JSON))


def test_a_task_drops_what_other_stages_left_in_its_worker():
    for name in ("encoder of packing", "word hashes", "mine"):
        module_cache(name, dict)
    batches = released(iter([1, 2]), "word hashes", keep="mine")
    assert next(batches) == 1
    assert {"word hashes", "mine"} <= set(common._CACHE) and "encoder of packing" not in common._CACHE
    assert list(batches) == [2]
    assert "mine" in common._CACHE and "word hashes" not in common._CACHE
    common._CACHE.pop("mine")
