import helpers

from zonalis.llm import fuzzy_lines


def test_short_and_unspaced_lines(spark):
    han = "".join(chr(0x4E00 + 37 * k % 5000) for k in range(60))
    texts = ["les.", "Les!", "and ornd.", "and  ornd", han, han, han[:30] + "x" + han[31:], "ab", "ac", "wxyzabcdefgh", "wxyzabXdefgh", "wxyzabcdefghi", "", ""]
    rows = [(k, t, "en", "a", 1, 1, "x", 0.5) for k, t in enumerate(texts)]
    gone = {r["doc_id"] for r in fuzzy_lines.removed_lines(helpers.frame(spark, rows)).collect()}
    assert gone == {1, 3, 5, 6, 10, 11}
