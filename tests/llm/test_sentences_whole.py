"""Words that end lines rarely are no abbreviations, however large the corpus."""

from leafmill.llm import sentences


def test_rare_line_ends_count(spark):
    words = [f"{chr(97 + i // 26)}{chr(97 + i % 26)}q" for i in range(60)]
    texts = [(i, "\n".join(f"So the {w}. Then he left.\nSee the {w}." for w in words)) for i in range(40)]
    texts += [(100 + i, "He asked the relieur. Then he left.\nShe asked Brg. Name again.\nOn the 3. garden day.\nSo it ... went on.") for i in range(20)]
    texts += [(200, "It was the relieur.\ngarden of the east\nAnd then it.\nIt is so.")]
    model = sentences.fit(spark.createDataFrame(texts, "doc_id long, text string"))
    assert "brg" in model.abbreviations and "relieur" not in model.abbreviations
    assert "garden" not in model.after_number and "it" not in model.pauses
    assert sentences.text_ends("He saw the relieur. Then he left.", model) == [19, 33]
