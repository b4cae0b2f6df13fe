"""Plain versions of the operators, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rule_metrics(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "base_failed": len(w) < 50 or 100 * len(covered) > 50 * len(w),
    }


def host_rates(rows):
    """rows: (host, failed). The hosts' shrunken rates and the mean of the prior."""
    n, f = Counter(), Counter()
    for host, failed in rows:
        if host is not None:
            n[host] += 1
            f[host] += failed
    rates = [f[h] / n[h] for h in n]
    if not rates:
        return {}, 0.0
    m = sum(rates) / len(rates)
    v = sum((r - m) ** 2 for r in rates) / len(rates)
    k = min(1000.0, max(1.0, m * (1 - m) / v - 1)) if v > 0 else 1000.0
    return {h: (f[h] + m * k) / (n[h] + k) for h in n}, m


def kept_by_rules(rows):
    """rows: (id, text, source). For each its metrics and whether base rules and the host's verdict let it stay."""
    from tablestore.llm import rules

    metrics = [rule_metrics(t) for _, t, _ in rows]
    some = [100 * m["n_symbols"] > rules.MAX_SYMBOL_PERCENT * m["word_chars"] or m["n_dup_lines"] > rules.MAX_DUP_LINES
            or 100 * m["n_repeat_words"] > rules.MAX_SOME_REPEAT_PERCENT * m["n_words"] for m in metrics]
    rates, mean = host_rates([(s, m["base_failed"] or x) for (_, _, s), m, x in zip(rows, metrics, some)])
    out = []
    for (_, _, s), m, x in zip(rows, metrics, some):
        falls = s is not None and (rates[s] > rules.MAX_HOST_RATE or rates[s] > rules.SUSPECT * mean and x)
        out.append((m, not m["base_failed"] and not falls))
    return out


def judge_url(url, listed, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in listed if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else default


def mix(rows, weights, epochs, key):
    """rows: (id, text, source). (id, size, source_size, target, taken), cut in key order."""
    sizes, by = defaultdict(int), defaultdict(list)
    for i, t, s in rows:
        n = len(WORD.findall(t or ""))
        sizes[s] += n
        by[s].append((key(i, t), n, i))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, list(names), float(sum(sizes.values()))
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > epochs * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = float(epochs * sizes[s])
            left -= target[s]
        open_ = [s for s in open_ if s not in over]
    out = []
    for s, items in by.items():
        budget = int(target[s])
        taken = [0] * len(items)
        order = sorted(range(len(items)), key=lambda i: items[i][:2])
        while budget and sizes[s]:
            for i in order:
                x = min(budget, items[i][1])
                taken[i] += x
                budget -= x
        out += [(items[i][2], items[i][1], sizes[s], target[s], taken[i]) for i in range(len(items))]
    return out


def mix_key(seed):
    def key(i, t):
        parts = [seed, "" if i is None else str(i)] + ([hashlib.md5((t or "").encode()).hexdigest()] if i is None else [])
        return hashlib.md5("|".join(parts).encode()).hexdigest()
    return key


def crc(text):
    return zlib.crc32((text or "").encode())


def trigram_scores(rows, priors):
    """rows: (id, text). id -> (held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    from math import log10

    def tokens(text):
        return [*("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in WORD.findall(text or "")), None]

    def histories(w, at):
        """The one and the two tokens before a token, the start of the text included; no two before the first."""
        whole = [0, *w]
        return (whole[at],), (whole[at - 1], whole[at]) if at else None

    learn = {i: zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows}
    words, after, contexts = Counter(), Counter(), Counter()
    for i, t in rows:
        if learn[i]:
            w = tokens(t)
            words.update(w)
            for at, x in enumerate(w):
                for h in histories(w, at):
                    after[h, x] += 1
                    contexts[h] += 1
    total, distinct = sum(words.values()), len(words)
    out = {}
    for i, t in rows:
        w = tokens(t)
        base = score = 0.0
        for at, x in enumerate(w):
            p = (words[x] + 1) / (total + distinct + 1)
            base += log10(p)
            for h, prior in zip(histories(w, at), priors):
                if h is not None:
                    p = (after[h, x] + prior * p) / (contexts[h] + prior)
            score += log10(p)
        out[i] = (not learn[i], len(w), sum(words[x] > 0 for x in w), total, base, score)
    return out


def repeated_windows(rows, window):
    """rows: (id, text). id -> (n_words, n_removed, kept_sha256)."""
    texts = [(i, WORD.findall(t or "")) for i, t in rows]
    seen = Counter(tuple(w[k:k + window]) for _, w in texts for k in range(len(w) - window + 1))
    out = {}
    for i, w in texts:
        gone = {k + j for k in range(len(w) - window + 1) if seen[tuple(w[k:k + window])] > 1 for j in range(window)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out
