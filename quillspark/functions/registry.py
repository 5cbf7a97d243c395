"""What each of the 48 measurements is: definition, range of values, how to read it, and what it can't tell."""

from __future__ import annotations

#: feature: (definition, unit_range, interpretation, limitations). Ranges are fixed values.
FEATURES: dict[str, tuple[str, str, str, str]] = {
    "surface_char_entropy": ("Shannon entropy of characters, in bits", "[0.0, 8.0]", "high: many different signs", "rises with alphabets and mark-up"),
    "surface_word_entropy": ("Shannon entropy of lower-case words, in bits", "[0.0, 15.0]", "high: words are spread evenly", "rises with length"),
    "surface_bigram_entropy": ("Shannon entropy of pairs of neighbouring words, in bits", "[0.0, 15.0]", "low: the same transitions come again", "nearly the logarithm of the length in short texts"),
    "surface_compression_ratio": ("bytes after zlib over bytes before", "[0.0, 1.0]", "low: the text repeats itself", "over 1 for a few words"),
    "surface_sent_len_mean": ("mean number of words of a sentence", "[0.0, 150.0]", "pace of the text", "depends on where sentences are cut"),
    "surface_sent_len_median": ("median number of words of a sentence", "[0.0, 150.0]", "pace without the outliers", "coarse for a few sentences"),
    "surface_sent_len_std": ("deviation of the sentence lengths", "[0.0, 100.0]", "how much the pace varies", "0 for one sentence"),
    "surface_sent_len_cv": ("deviation of the sentence lengths over their mean", "[0.0, 5.0]", "variation apart from the pace", "unstable for very short sentences"),
    "surface_sent_delta_variance": ("variance of the change of length from sentence to sentence", "[0.0, 500.0]", "bursts of long and short sentences", "needs two sentences"),
    "surface_sent_delta_mean_abs": ("mean size of the change of length from sentence to sentence", "[0.0, 100.0]", "how fast the pace changes", "needs two sentences"),
    "surface_ttr": ("distinct words over words", "[0.0, 1.0]", "high: rich vocabulary", "falls with length"),
    "surface_root_ttr": ("distinct words over the square root of words", "[0.0, 50.0]", "richness, less bound to length", "an approximation"),
    "surface_hapax_ratio": ("words used once over distinct words", "[0.0, 1.0]", "high: hardly a word comes again", "misspellings count as words"),
    "surface_stopword_ratio": ("function words over words", "[0.0, 1.0]", "share of grammar", "English list"),
    "surface_top10_concentration": ("share of the ten commonest words", "[0.0, 1.0]", "high: few words do most of the work", "1 for ten words"),
    "surface_pos_noun_ratio": ("nouns over tagged words", "[0.0, 1.0]", "nominal style", "tags come from word endings"),
    "surface_pos_verb_ratio": ("verbs over tagged words", "[0.0, 1.0]", "verbal style", "tags come from word endings"),
    "surface_pos_adj_ratio": ("adjectives over tagged words", "[0.0, 1.0]", "description", "tags come from word endings"),
    "surface_pos_adv_ratio": ("adverbs over tagged words", "[0.0, 1.0]", "qualification", "tags come from word endings"),
    "surface_pos_pronoun_ratio": ("pronouns over tagged words", "[0.0, 1.0]", "how personal the text is", "English list"),
    "surface_pos_prep_ratio": ("prepositions over tagged words", "[0.0, 1.0]", "how much things are put in relation", "English list"),
    "surface_passive_ratio": ("passive forms over sentences", "[0.0, 5.0]", "passive style", "0 with the rule tagger, which knows no participles"),
    "surface_comma_rate": ("commas in 100 words", "[0.0, 20.0]", "length of clauses", "a matter of taste"),
    "surface_semicolon_rate": ("semicolons in 100 words", "[0.0, 10.0]", "long coordination", "a matter of taste"),
    "surface_colon_rate": ("colons in 100 words", "[0.0, 10.0]", "lists and explanations", "times and headings count too"),
    "surface_emdash_rate": ("dashes and hyphens in 100 words", "[0.0, 10.0]", "interruptions", "compounds count too"),
    "surface_quote_rate": ("straight quotation marks in 100 words", "[0.0, 15.0]", "speech and quotation", "apostrophes count too, curly marks don't"),
    "surface_parentheses_rate": ("parentheses in 100 words", "[0.0, 10.0]", "asides", "a matter of taste"),
    "surface_para_len_mean": ("mean number of words of a paragraph", "[0.0, 500.0]", "size of the parts", "depends on layout"),
    "surface_para_len_std": ("deviation of the paragraph lengths", "[0.0, 200.0]", "high: parts of unlike size", "depends on layout"),
    "discourse_agency_action_density": ("first persons followed by an active verb within three words, in 100 words", "[0.0, 20.0]", "the narrator acts", "English lists"),
    "discourse_agency_passive_density": ("first persons followed by a verb of state within three words, in 100 words", "[0.0, 20.0]", "things happen to the narrator", "English lists"),
    "discourse_agency_ratio": ("action over action and state", "[0.0, 1.0]", "high: an active narrator", "0 where neither occurs"),
    "discourse_reflection_density": ("phrases of insight in 100 words", "[0.0, 15.0]", "how much the text reflects", "English phrases"),
    "discourse_reflection_intro_ratio": ("share of those in the first third", "[0.0, 1.0]", "reflects from the start", "0 where there are none"),
    "discourse_reflection_body_ratio": ("share of those in the middle third", "[0.0, 1.0]", "reflects along the way", "0 where there are none"),
    "discourse_reflection_conclusion_ratio": ("share of those in the last third", "[0.0, 1.0]", "saves the lesson for the end", "0 where there are none"),
    "discourse_reflection_mean_pos": ("mean place of those in the text", "[0.0, 1.0]", "high: late", "0.5 where there are none"),
    "discourse_formulaic_moral_density": ("stock phrases in 100 words", "[0.0, 10.0]", "ready-made morals", "English phrases"),
    "discourse_causal_density": ("words of cause in 100 words", "[0.0, 15.0]", "reasoning", "English phrases"),
    "discourse_temporal_density": ("words of time in 100 words", "[0.0, 15.0]", "narration", "English phrases"),
    "discourse_abstract_vocab_density": ("abstract words in 100 words", "[0.0, 20.0]", "lofty style", "fixed English list"),
    "discourse_concrete_density": ("things, senses and numbers in 100 words", "[0.0, 20.0]", "grounded style", "fixed English list"),
    "discourse_concrete_abstract_ratio": ("concrete over concrete and abstract", "[0.0, 1.0]", "high: grounded", "0 where neither occurs"),
    "dist_human_euclidean": ("distance from the mean human text, each measurement in human deviations", "[0.0, 50.0]", "high: unlike human texts", "all measurements weigh alike"),
    "dist_human_mahalanobis": ("the same, less what measurements have in common", "[0.0, 50.0]", "high: unlike human texts", "far too large where few human texts were seen"),
    "dist_human_cosine": ("cosine with the mean human text", "[-1.0, 1.0]", "near 1: the same proportions", "large measurements decide"),
    "dist_structural_dispersion": ("mean variance of the measurements between paragraphs", "[0.0, 100.0]", "high: paragraphs differ", "0 for one paragraph"),
}
