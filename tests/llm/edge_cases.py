"""Documents with every edge case the operators state a result for."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, row_hash string, kept string"


def passage(seed: int, n: int) -> str:
    return " ".join(f"w{(seed * 7919 + i * 104729) % 99991}" for i in range(n))


def doc(doc_id, text):
    return doc_id, text, "en", "s", None if text is None else len(text), "clash", "clash", "clash"


def edge_rows() -> list[tuple]:
    """Nulls, empty and blank texts, repeated rows, copies, near copies, a shared passage and a very long text."""
    shared, own = passage(1, 80), passage(2, 60)
    near = own.split()
    near[30] = "changed"
    return [doc(None, None), doc(None, passage(9, 70)), doc(1, None), doc(2, ""), doc(3, " \n\t "), doc(4, "one two"),
            doc(4, "one two"), doc(5, own), doc(6, own), doc(7, " ".join(near)), doc(8, passage(3, 40) + " " + shared),
            doc(9, shared + "\n" + passage(4, 90)), doc(10, "é😀 naïve  text\n" * 3), doc(11, "rep " * 400),
            doc(12, passage(5, 30000)), doc(13, passage(6, 200) + " " + shared + " " + passage(7, 10))]
