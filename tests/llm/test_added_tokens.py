import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm import token_store as T

BYTES = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["first part<|endoftext|>second part", "<|endoftext|>", "<|endoftext|><|endoftext|> a", "x <|endoftext|>\n\n y", "<|endoftext", "|> <|endoftext |>", "<|endof", "text|>", "é<|endoftext|>é", "a<|<|endoftext|>|>b", None, ""]


def test_ids_of_added_tokens_equal_the_library():
    library = Tokenizer.from_file(BYTES)
    got = []
    for _, _, ids, counts in T.TextEncoder(BYTES).rows(pa.array(TEXTS), 2):
        got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [[*library.encode(t or "", add_special_tokens=False).ids, 2] for t in TEXTS]
