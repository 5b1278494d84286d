import random

from ranklane.llm import language_id


def test_more_than_64_languages_are_predicted():
    rng = random.Random(1)
    words = {f"l{k:03}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(30)] for k in range(150)}
    rows = [(lang, " ".join(rng.choices(own, k=60))) for lang, own in words.items() for _ in range(2)]
    filters = language_id.LanguageFilter(rows)
    langs, _ = filters.predict([" ".join(own).encode() for own in words.values()])
    assert len(filters.languages) == 150 and langs == list(words)
