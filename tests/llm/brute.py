"""Plain versions of the corpus operators, for small inputs."""

import base64
import hashlib
import re

import numpy as np
import public_tokenizers
import tiktoken
import xxhash

RULES = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
     lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)


def secret_spans(text):
    found = sorted((m.start(), k, m.end(), name) for k, (name, rule, ok) in enumerate(RULES)
                   for m in rule.finditer(text or "") if ok(m))
    return ",".join(f"{name}:{start}:{end}" for start, _, end, name in found)


def fingerprint(text, words=3):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(found[i:i + words]) for i in range(max(1, len(found) - words + 1))] if found else []
    ones = [0] * 64
    for run in runs:
        h = xxhash.xxh64_intdigest(run.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(runs)) if runs else 0


def component_names(prints, distance=3):
    """The smallest id that each id reaches; ``prints``: fingerprint by id."""
    ids = sorted(prints)
    bits = np.array([prints[i] for i in ids], np.uint64)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(bits ^ bits[k]) <= distance):
            a, b = root(i), root(ids[j])
            up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def encoder():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_digests(text, encode):
    ids = encode(text or "")
    data = (text or "").encode()
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(data).hexdigest()


def top_products(vectors, k, scale=1024):
    """{query: [(id, score)]} over whole vectors by id."""
    whole = {i: [int(np.floor(scale * float(v))) for v in x] for i, x in vectors.items()}
    return {
        q: sorted(((sum(a * b for a, b in zip(whole[q], x)), -i) for i, x in whole.items() if i != q), reverse=True)[:k]
        for q in whole
    }
