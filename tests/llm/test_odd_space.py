import random

import pyarrow as pa
import pyarrow.compute as pc

from flowlens.llm.token_store import ODD_SPACE


def test_odd_space_is_all_but_single_spaces_and_line_feeds():
    spaces = [c for c in map(chr, range(0x3100)) if c.isspace()]
    letters = spaces + list("abé漢🙂") * 3 + [" ", "\n"] * 12
    rng = random.Random(1)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(20_000)] + [f"a{c}b" for c in spaces] + ["a b\nc" * 5_000]
    want = [" ".join(x.split()) != x.replace("\n", " ") for x in texts]
    assert pc.match_substring_regex(pa.array(texts), ODD_SPACE).to_pylist() == want
    assert 0 < sum(want) < len(want)
