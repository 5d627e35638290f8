"""Operator 8 by brute force: every run of tokens of a host as a tuple, counted over all its pages."""

from collections import defaultdict

from lodestar.llm import html


def grams(texts):
    tokens = [w for t in texts for w in t.split(" ")]
    return [tuple(tokens[i : i + html.RUN]) for i in range(len(tokens) - html.RUN + 1)]


def marked(tokens, repeated):
    out = [False] * len(tokens)
    for i in range(len(tokens) - html.RUN + 1):
        if tuple(tokens[i : i + html.RUN]) in repeated:
            out[i : i + html.RUN] = [True] * html.RUN
    return out


def list_grams(found):
    return {g for group in html.link_groups(found) for g in grams([found[i].text for i in group])}


def plain_texts(pages):
    """Main texts of all pages of one host."""
    read = [html.read_page(p) for p in pages]
    copies = defaultdict(list)
    for p in read:
        own = {*grams([b.text for b in p.kept])} if p.open else set()
        copies[p.open, " ".join(b.text for b in p.kept)].append((own, list_grams(p.kept) | list_grams(p.rest)))
    counts = [defaultdict(int) for _ in range(2)]
    for found in copies.values():
        assert all(f == found[0] for f in found), "the copies in these tests have equal menus"
        for count, keys in zip(counts, found[0], strict=True):
            for k in keys:
                count[k] += 1
    n_open, n = sum(is_open for is_open, _ in copies), len(copies)
    bulk = {k for k, c in counts[0].items() if c >= max(html.LEAST, html.SHARE * n_open)}
    menus = {k for k, c in counts[1].items() if c >= max(html.LEAST, html.SHARE * n)}
    return [_text(p, bulk, menus) for p in read]


def _text(p, bulk, menus):
    gone = set()
    for group in html.link_groups(p.kept):
        tokens = [w for i in group for w in p.kept[i].text.split(" ")]
        cover, at = marked(tokens, menus), 0
        for i in group:
            size = len(p.kept[i].text.split(" "))
            if all(cover[at : at + size]):
                gone.add(i)
            at += size
    if not p.open:
        return "\n\n".join(b.text for i, b in enumerate(p.kept) if i not in gone)
    cover, at, kept = marked([w for b in p.kept for w in b.text.split(" ")], bulk), 0, []
    for i, b in enumerate(p.kept):
        words = b.text.split(" ")
        if i not in gone and not all(cover[at : at + len(words)]):
            kept.append(" ".join(w for w, m in zip(words, marked(words, bulk), strict=True) if not m))
        at += len(words)
    return "\n\n".join(kept)
