"""Small documents with everything that may go wrong, and plain versions of what the operators compute."""

import re

FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SHARED = "This line of more than forty characters is shared by many documents."
#: columns of the schema, and some that operators may use themselves
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, id long, same string, digest string, task int, rank int, "
    "part int, found string, n_lines string, kept string, contamination string, score string, gone int, row int"
)


def edge_rows():
    texts = [
        (0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "Two words"), (5, SHARED), (6, f" {SHARED.upper()} \nown line of six"),
        (7, f"{SHARED}\n{SHARED}\nx"), (8, f"a\n\n{SHARED}\n"), (9, f"{SHARED}\r\nb"), (None, f"{SHARED}\nno id"), (None, None),
        (10, "The same words again and again in one text. " * 3), (11, "The same words again and again in one text. " * 3),
        (11, "The same words again and again in one text. " * 3), (12, "word " * 30_000), (13, "x" * 50_000),
        (14, "日本語のテキスト 123 😀 <|endoftext|> tail"), (15, "call +1 (555) 123-4567 or mail Bob.Smith@example.com, host 10.0.0.1"),
        (16, "4111 1111 1111 1111 is a card, 1.2.3.999 is no host"), (17, "\0 odd \x1c characters \x85 here"),
        (18, "Erreur de la langue et des mots"), (-5, f"negative id\n{SHARED}"),
    ]
    return [
        (i, t, "en" if n % 2 else None, "s", len(t or ""), n, "z", "z", n, n, n, "z", "z", "z", "z", "z", n, n)
        for n, (i, t) in enumerate(texts)
    ]


def edge_documents(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(table, *columns):
    """Rows as a sorted list of tuples, nulls first."""
    return sorted((tuple(r[c] for c in columns) for r in table.select(*columns).collect()), key=repr)


def shingle_set(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").encode().translate(FOLD).decode())
    return frozenset(tuple(found[k : k + words]) for k in range(max(1, len(found) - words + 1))) if found else frozenset()


def near_components(rows, words, threshold):
    """{row number: smallest id reachable}, by comparing all pairs of sets that share a shingle."""
    sets = [shingle_set(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    seen = set()
    for group in where.values():
        for n, a in enumerate(group):
            for b in group[:n]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    common = len(sets[a] & sets[b])
                    if common * 10_000 >= round(threshold * 10_000) * (len(sets[a]) + len(sets[b]) - common):
                        parent[find(a)] = find(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [(len(s), rows[i][0] if not s else least.get(find(i))) for i, s in enumerate(sets)]
