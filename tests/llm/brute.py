"""Plain versions of the operators, for small inputs."""

import collections
import math
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {i: i + 32 for i in range(65, 91)}


def words(text, fold=False):
    text = text or ""
    return WORD.findall(text.translate(FOLD) if fold else text)


def shingles(text, k):
    w = words(text, fold=True)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(rows, k, percent):
    """id -> (set size, smallest id reachable)."""
    sets = {i: shingles(t, k) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def lines_kept(rows, size=3):
    """id -> text."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        if t is None:
            out[i] = None
            continue
        lines = t.split("\n")
        gone = set()
        for k in range(len(lines) - size + 1):
            w = tuple(lines[k : k + size])
            if not any(x.strip() for x in w):
                continue
            if w in seen:
                gone |= set(range(k, k + size))
            seen.add(w)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def spans_kept(rows, size):
    """id -> (words, removed, text)."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        gone = set()
        for k in range(len(w) - size + 1):
            s = tuple(w[k : k + size])
            if s in seen:
                gone |= set(range(k, k + size))
            seen.add(s)
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def contained(docs, items, k=5, percent=80):
    out = set()
    inverted = collections.defaultdict(set)
    sets = {i: shingles(t, k) for i, t in docs}
    for i, s in sets.items():
        for x in s:
            inverted[x].add(i)
    for j, t in items:
        s = shingles(t, k)
        c = collections.Counter(i for x in s for i in inverted[x])
        out |= {(i, j, len(s), n) for i, n in c.items() if 100 * n >= percent * len(s)}
    return out


# ---------------------------------------------------------------- secrets

KEY_CHARS = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
OUT_OF_VALUES = set("\"'`,;()[]{}<>")


def _stretches(word, inside, least):
    out, at = [], 0
    for k in range(len(word) + 1):
        if k == len(word) or not inside(word[k]):
            if k - at >= least:
                out.append(word[at:k])
            at = k + 1
    return out


def _ends_with_sign(text):
    return text.rstrip("\"'`")[-1:] in ("=", ":")


def holds_name(text, names):
    """Whether one of the names, also with an s, stands in the text with no letter or digit next to it."""
    text = text.lower()
    plain = lambda c: not (c.isascii() and c.isalnum())
    for name in names:
        for end in (name, name + "s"):
            at = text.find(end)
            while at >= 0:
                if (at == 0 or plain(text[at - 1])) and (at + len(end) == len(text) or plain(text[at + len(end)])):
                    return True
                at = text.find(end, at + 1)
    return False


def _value_behind_inline_name(word, names, least):
    """What is assigned within the word, if the sign follows a name of secrets and the value is long enough, else None."""
    low, hit = word.lower(), False
    for at in range(1, len(word)):
        if word[at] in "=:":
            head = low[:at]
            head = head[:-1] if head[-1:] in ("\"", "'", "`") else head
            rest = word[at + 1 :].lstrip("\"'`")
            lead = next((k for k, c in enumerate(rest) if c in OUT_OF_VALUES), len(rest))
            hit = hit or any(head.endswith(n) or head.endswith(n + "s") for n in names) and lead >= least
    if not hit:
        return None
    for at in range(len(word)):  # the value behind the first sign that a value follows
        if word[at] in "=:":
            rest = word[at + 1 :].lstrip("\"'`")
            lead = next((k for k, c in enumerate(rest) if c in OUT_OF_VALUES), len(rest))
            if lead >= least:
                return rest[:lead]
    return None


def candidates(rows, names, least_run=16, least_value=8):
    """[(id, word_no, nth, candidate)] of rows (id, text)."""
    out = []
    for i, text in rows:
        words = re.split(r"[ \t\n\x0b\f\r]+", text or "")
        for k, word in enumerate(words):
            before = " ".join(words[max(0, k - 3) : k])
            behind = k > 0 and _ends_with_sign(words[k - 1]) and _ends_with_sign(before)
            runs = _stretches(word, KEY_CHARS.__contains__, least_run)
            value = _value_behind_inline_name(word, names, least_value)
            own = _stretches(word, lambda c: c not in OUT_OF_VALUES, least_value)
            if value is None and behind and holds_name(before, names) and own:
                value = own[0]
            if value is not None and all(c.isascii() and c.isalpha() for c in value):
                value = None
            introduced = behind or any(c in "=:" and _stretches(word[j + 1 :].lstrip("\"'`")[:least_run], KEY_CHARS.__contains__, least_run) for j, c in enumerate(word))
            runs = [r for r in runs if introduced or any(c.isascii() and c.isdigit() for c in r) and any(c.isascii() and c.isalpha() for c in r)]
            found = runs if value is None else [value, *(r for r in runs if r not in value)]
            out += [(i, k, n, c) for n, c in enumerate(found)]
    return out


def secret_features(c, word, before, after, dictionary, secret, benign):
    n = max(len(c), 1)
    kind = lambda x: "a" if "a" <= x <= "z" else "A" if "A" <= x <= "Z" else "0" if "0" <= x <= "9" else "-"
    kinds = [kind(x) for x in c]
    share = lambda test: sum(map(bool, map(test, c))) / n
    covered, at, low = 0, 0, c.lower()
    while at < len(low):  # the longest word that starts here
        size = max((k for k in range(1, len(low) - at + 1) if low[at : at + k] in dictionary), default=0)
        covered, at = covered + size, at + (size or 1)
    letters = _stretches(c, lambda x: x.isascii() and x.isalpha(), 1)
    lead = word[: word.find(c)] if c and c in word else "" if not c else word
    signed = lambda text: text.rstrip("\"'`")[-1:] in ("=", ":")
    tail = word.rstrip("\"',;)")
    dot = tail.rfind(".")
    return {
        "length": n, "digits": share(lambda x: "0" <= x <= "9"), "uppers": share(lambda x: "A" <= x <= "Z"), "symbols": share(lambda x: kind(x) == "-"),
        "hexes": share(lambda x: x in "0123456789abcdefABCDEF"), "transitions": sum(a != b for a, b in zip(kinds, kinds[1:])) / n, "vowels": share(lambda x: x in "aeiouAEIOU"),
        "longest_run": max(map(len, letters), default=0) / n, "distinct": len(set(c)) / n, "coverage": covered / n, "slashes": min(word.count("/"), 9), "dots": min(word.count("."), 9),
        "url": "://" in word or word.startswith("www.") or "@" in word or "data:" in word,
        "extension": dot >= 0 and 1 <= len(tail) - dot - 1 <= 4 and all(x.isascii() and x.isalpha() for x in tail[dot + 1 :]),
        "hyphens": c.count("-") / n, "before_secret": holds_name(before, secret), "before_benign": holds_name(before, benign), "after_benign": holds_name(after, benign),
        "assigned": signed(lead) or not any(x.isascii() and x.isalnum() for x in lead) and signed(before), "quoted": lead[-1:] in ("\"", "'", "`") and lead != "", "inside_secret": holds_name(lead, secret),
    }


# ---------------------------------------------------------------- pages


def dom_html(node):
    """The page of a tree: a node is a text or (tag, [nodes])."""
    if isinstance(node, str):
        return node
    return f"<{node[0]}>" + "".join(map(dom_html, node[1])) + f"</{node[0]}>"


def densities(body):
    """(tag, characters, density, sum of the children's densities) of every node of a tree, parents first, by definition."""

    def told(node):
        if isinstance(node, str):
            return len(node.strip()), 0, 0, 0
        parts = [told(x) for x in node[1]]
        c, tags, lc, lt = (sum(p[k] for p in parts) for k in range(4))
        tags += sum(not isinstance(x, str) for x in node[1])
        lt += sum(not isinstance(x, str) and x[0] == "a" for x in node[1])
        return (c, tags, c, lt) if node[0] == "a" else (c, tags, lc, lt)

    whole = told(body)
    ratio = whole[2] / whole[0] if whole[0] else 0

    def density(node):
        c, t, lc, lt = told(node)
        if node[0] == "a":
            lt += 1
        if not c:
            return 0.0
        t = max(t, 1)
        base = max(math.log(math.log(c * lc / max(c - lc, 1) + ratio * c + math.e)), 1.0)
        return c / t * max(math.log(max(c * t / (max(lc, 1) * max(lt, 1)), 1)) / base, 0.0)

    out = []

    def walk(node):
        inner = [x for x in node[1] if not isinstance(x, str)]
        out.append((node[0], told(node)[0], density(node), sum(map(density, inner))))
        for x in inner:
            walk(x)

    walk(body)
    return out
