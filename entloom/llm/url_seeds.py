"""Seed names of blocked sites, and the labelled URLs that train the URL filter."""

#: Registered names of blocked sites, without the suffix: a site counts under any suffix.
BLOCKED = ("ads-track.example", "adult-x.example", "casino-win.example", "cheap-pills.example", "free-bets.example", "spam-farm.example")
#: Registered names of ordinary sites, some with hyphens, which alone are no sign of junk.
ORDINARY = tuple(
    f"{name}.example"
    for name in (
        "archive atlas avenue bakery bookshop bridge canal castle choir cinema clinic coast college council courier daily dictionary energy engine festival finance forest gallery garden gazette geology harbour harvest herald history hospital island journal kitchen "
        "ledger library lighthouse maths meadow mountain museum music nature north observatory opera orchard parish parliament physics planet poetry post radio railway recipes research river school science society station stones study theatre tides "
        "tower travel university valley village voyage weather weekly winter workshop writers zoo "
        "book-club city-library green-valley local-radio new-town-herald old-mill open-science tea-house the-daily-post wood-craft"
    ).split()
)

_PREFIXES = ("", "www.", "m.", "blog.", "shop.")
_SUFFIXES = ("com", "org", "net", "info", "eu")
_ENDS = ("", "/", ".html", "#top", "?page=2&ref=x", "?utm_source=feed", "?id=7")
_FOLDERS = ("en", "de", "news", "a/b")


def labelled_urls() -> list[tuple[str, int]]:
    """(url, label) of every listed site: prefixes, suffixes, schemes and paths are the same for both labels, so only the names tell them apart."""
    found, k = [], 0
    for names, label, times in ((BLOCKED, 1, 4), (ORDINARY, 0, 1)):
        for name in names:
            for prefix in _PREFIXES:
                for suffix in _SUFFIXES:
                    for _ in range(times):
                        k += 1
                        path = (f"/{_FOLDERS[k // 3 % 4]}/{k * 7919 % 10 ** (1 + k % 6)}{_ENDS[k % 7]}", "/", "")[0 if k % 9 else k // 9 % 3]
                        found.append((f"http{'s' * (k % 3 > 0)}://{prefix}{name}.{suffix}{path}", label))
    return found
