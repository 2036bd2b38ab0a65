"""Plain versions of the operators, one document or one pair at a time."""

import collections
import hashlib
import re

SPACED = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text):
    text, out = text or "", []
    bare = lambda m: re.sub("[^0-9]", "", m[0])
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 12 <= len(bare(m)) <= 19 and luhn(bare(m)):
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(bare(m)) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return sorted(out)


def pii(text):
    spans = base_spans(text)
    counts = collections.Counter(s[2] for s in spans)
    return (*(counts[k] for k in ("email", "ip", "card", "phone")), sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)))


def shingle_set(text, n):
    words = re.findall(SPACED, lower(text))
    k = min(n, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


def groups(docs, n, percent):
    """(n_shingles, component) of each (doc_id, text); doc_ids may repeat."""
    sets = [(d, shingle_set(t, n)) for d, t in docs]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            both = len(a & b)
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(len(s), least[find(i)]) for i, (_, s) in enumerate(sets)]


def contamination(docs, items, span=13):
    windows = collections.defaultdict(set)
    for item, text in items:
        words = re.findall(ALNUM, lower(text))
        for k in range(max(1, len(words) - span + 1)) if words else ():
            windows[tuple(words[k : k + span])].add("null" if item is None else str(item))
    out = []
    for doc, text in docs:
        words, hit, found = re.findall(ALNUM, lower(text)), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                if own := windows.get(tuple(words[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        out.append((doc, len(words), len(hit), len(found), sha(",".join(sorted(found))), len(hit) > 0 and 20 * len(hit) >= len(words)))
    return out


def quality(text):
    text = text or ""
    words, places, repeated = re.findall(SPACED, text), collections.defaultdict(list), set()
    for k in range(len(words) - 4):
        places[tuple(words[k : k + 5])].append(k)
    for starts in places.values():
        if len(starts) > 1:
            repeated.update(k + j for k in starts for j in range(5))
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(SPACED, line):
            again += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(repeated), failed)


def lines(docs, least=20, least_docs=3):
    key = lambda x: lower(x.strip(" \t\n\v\f\r"))
    holders = collections.defaultdict(set)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least and doc is not None:
                holders[key(line)].add(doc)
    out = []
    for doc, text in docs:
        own = (text or "").split("\n")
        kept = [x for x in own if doc is None or len(key(x)) < least or len(holders[key(x)]) < least_docs or max(holders[key(x)]) == doc]
        out.append((doc, len(own), len(own) - len(kept), sha("\n".join(kept))))
    return out


def archive(pages):
    largest = {}
    for page, html in pages:
        raw = (html or "").encode()
        if len(raw) >= 1000 and page is not None:
            largest[raw] = max(largest.get(raw, page), page)
    out = []
    for page, html in pages:
        raw = (html or "").encode()
        other = largest.get(raw) if page is not None and largest.get(raw) != page else None
        out.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "response" if other is None else "revisit", other))
    return out


def conversations(rows):
    turns = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        turns[conv].append((-1 if turn is None else turn, role or "", text or ""))
    out = []
    for conv, own in turns.items():
        own.sort(key=lambda t: (t[0], sha(t[1]), sha(t[2])))
        loss = "".join(t for _, r, t in own if r == "assistant")
        out.append((conv, len(own), sha("".join(f"{r}\n{t}\n" for _, r, t in own)), len(loss), sha(loss)))
    return out


def mix_targets(docs, weights=(1, 2, 3), most=3):
    """doc_id, size, source_size and target of each (doc_id, text, source)."""
    size = lambda t: len(re.findall(SPACED, t or ""))
    words = collections.Counter()
    for _, text, source in docs:
        words[source] += size(text)
    ordered = sorted((s for s in words if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in words)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(ordered)}
    full = set()
    while True:
        left, share = sum(words.values()) - sum(most * words[s] for s in full), sum(weight[s] for s in ordered if s not in full)
        target = {s: most * words[s] if s in full else left * weight[s] / share for s in ordered}
        over = {s for s in ordered if s not in full and target[s] > most * words[s]}
        if not over:
            return [(d, size(t), words[s], round(float(target[s]), 6)) for d, t, s in docs]
        full |= over


def middle(doc, text):
    text, digest = text or "", sha(f"7:{'' if doc is None else doc}")
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    h1, h2, _, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, mid, suffix = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    form = "spm" if h4 % 100 < 50 else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{mid}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{mid}"
    return n, form, len(prefix), len(mid), sha(out), sha(text)


def phrases(docs, max_n=3, least=10, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) of docs (lang, text)."""
    counts, total = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in docs:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text)):
            words = re.findall("[^ \t]+", piece)
            total[lang or "und"] += len(words)
            for k in range(1, max_n + 1):
                counts[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        wanted = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        scored = []
        for p, a in wanted.items():
            if any(len(q) > len(p) and inside(p, q) and 100 * b >= 50 * a for q, b in wanted.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return out
