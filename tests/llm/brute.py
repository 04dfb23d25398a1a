"""Plain Python versions of the operators, to compare with."""

import collections
import hashlib
import re

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return PLAIN.findall((text or "").translate(LOWER))


def spaced_words(text):
    return SPACED.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def classes(docs, n=5, threshold=0.8):
    """``{doc_id: (class_id, n_links, n_copies)}`` of ``(doc_id, text)`` rows with distinct ids."""
    sets = {}
    for key, text in docs:
        words = plain_words(text)
        sets[key] = frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))
                              ) if words else None
    members = collections.defaultdict(list)
    for key, own in sets.items():
        if own:
            members[own].append(key)
    distinct, holders = list(members), collections.defaultdict(list)
    for i, own in enumerate(distinct):
        for gram in own:
            holders[gram].append(i)
    parent, links = list(range(len(distinct))), [0] * len(distinct)

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, own in enumerate(distinct):
        shared = collections.Counter(j for gram in own for j in holders[gram] if j < i)
        for j, m in shared.items():
            if m >= threshold * (len(own) + len(distinct[j]) - m) - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[max(top(i), top(j))] = min(top(i), top(j))
    first = {}
    for i, own in enumerate(distinct):
        first[top(i)] = min([*members[own], first.get(top(i), float("inf"))])
    out = {key: (key, 0, 1) for key in sets}
    for i, own in enumerate(distinct):
        for key in members[own]:
            out[key] = first[top(i)], links[i], len(members[own])
    return out


def removals(docs, window=20):
    """``{doc_id: (n_words, n_removed, kept_sha256)}``; a null id comes first."""
    seen, out = set(), {}
    for key, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        words, gone = spaced_words(text), set()
        for i in range(len(words) - window + 1):
            own = tuple(words[i : i + window])
            if own in seen:
                gone |= set(range(i, i + window))
            seen.add(own)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out[key] = len(words), len(gone), sha(kept)
    return out


def contamination(docs, items, window=10):
    """``{doc_id: (n_words, n_hit, n_items, items_sha256, contaminated)}``."""
    windows = collections.defaultdict(set)
    for item, text in items:
        words = plain_words(text)
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            windows[tuple(words[i : i + size])].add(item)
    sizes, out = {len(w) for w in windows}, {}
    for key, text in docs:
        words, hit, found = plain_words(text), set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                own = windows.get(tuple(words[i : i + size]))
                if own:
                    found |= own
                    hit |= set(range(i, i + size))
        ids = sorted(str(x) for x in found if x is not None)
        out[key] = len(words), len(hit), len(ids), sha(",".join(ids)), bool(hit)
    return out


def line_verdicts(rows, least=10, share=0, least_left=0.2, texts=None):
    """A list, in the order of the rows ``(doc_id, text, source)``, of verdicts; ``texts`` gets the
    texts that are left."""
    def normal(line):
        return re.sub(r"[\x20\x09-\x0D]+", " ", line).strip(" ").lower()

    hosts, holders, first = collections.defaultdict(set), collections.defaultdict(set), {}
    for key, text, host in rows:
        text = text or ""
        hosts[host].add(text)
        for line in text.split("\n"):
            if spaced_words(line):
                own = host, normal(line)
                holders[own].add(text)
                order = (key is not None, key or 0)
                first[own] = min(first.get(own, ((9,), None)), (order, text), key=lambda x: x[0])
    out = []
    for key, text, host in rows:
        text = text or ""
        words, lines = spaced_words(text), [x for x in text.split("\n") if spaced_words(x)]
        grams = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        twice = {p for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1
                 for p in range(i, i + 8)}
        often = {x for x in lines
                 if len(holders[host, normal(x)]) > max(least, share * len(hosts[host]))
                 and first[host, normal(x)] != ((key is not None, key or 0), text)}
        gone = sum(len(spaced_words(x)) for x in lines if x in often)
        failed = len(words) < 20 or 100 * len(twice) > 30 * len(words)
        out.append((key, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
                    len(lines) - len(set(lines)), len(twice), failed, gone,
                    not failed and len(words) - gone >= least_left * len(words)))
        if texts is not None:
            texts.append("\n".join(x for x in text.split("\n") if x not in often))
    return out
