"""The lexicon over joined texts."""

from review_insights.operators import scoring


def test_a_call_looks_for_each_word_in_all_texts_at_once():
    made = ["great tea but stale", None, "", "bad"] * 50 + ["bestale", "wasteasty nice", "GREAT great great", "bad\nbad good", "sl\now", "", "slow"]
    lows = [(t or "").lower() for t in made]
    ends = [sum(len(x) + 1 for x in lows[:k + 1]) for k in range(len(lows))]
    assert scoring.PandasLexiconScorer._hits("\n".join(lows), ends, scoring.NEGATIVE_WORDS) == [
        sum(w in low for w in scoring.NEGATIVE_WORDS) for low in lows]
    assert scoring.PandasLexiconScorer()(made) == [r for t in made for r in scoring.PandasLexiconScorer()([t])]
