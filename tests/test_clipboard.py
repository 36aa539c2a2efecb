"""Pastes in several forms."""

from lexiflow.sources import clipboard as C

BLOCK = "paste_id long, pos int, type string, text string, data_url string, alt string"


def test_forms_of_pastes(spark):
    pastes = [(1, True), (2, False), (3, None), (4, True), (5, True), (6, True), (7, True), (8, True)]
    rich = [(1, 1, "paragraph", "rich", None, None), (1, 2, "imageMissing", None, None, "gap"), (2, 1, "paragraph", "unused", None, None), (5, 1, "image", None, "data:x", "own"), (6, 1, "imageMissing", None, None, None), (6, 2, "imageMissing", None, None, None)]
    rich += [(8, 1, "paragraph", "many", None, None), (9, 1, "paragraph", "no such paste", None, None)]
    plain = [(1, 1, "paragraph", "unused", None, None), (2, 1, "paragraph", "plain", None, None)]
    photos = [(1, 1, "data:a", None), (3, 2, "data:c", "second"), (3, 1, "data:b", "first"), (5, 1, "data:x", "same"), (6, 1, "data:d", None), (7, 1, None, "empty"), *((8, k, f"data:{k}", None) for k in range(51))]
    frames = [spark.createDataFrame(pastes, "paste_id long, has_html boolean"), spark.createDataFrame(rich, BLOCK), spark.createDataFrame(plain, BLOCK), spark.createDataFrame(photos, "paste_id long, nth int, data_url string, alt string")]
    got = [tuple(r) for r in C.merged_pastes(*frames).orderBy("paste_id", "pos").collect()]
    assert got == [
        (1, 1, "paragraph", "rich", None, None), (1, 2, "image", None, "data:a", ""), (2, 1, "paragraph", "plain", None, None),
        (3, 1, "image", None, "data:b", "first"), (3, 2, "image", None, "data:c", "second"), (5, 1, "image", None, "data:x", "own"),
    ]
    assert {tuple(r) for r in C.paste_problems(*frames).collect()} == {(4, "nothing to read"), (6, "photos without a place"), (7, "nothing to read"), (8, "too many photos")}
    assert C.merged_pastes(frames[0].limit(0), *frames[1:]).count() == 0
