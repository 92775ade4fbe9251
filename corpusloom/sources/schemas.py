"""Schemas of the files that the corpus work reads and writes."""

from __future__ import annotations

RAW_COMMENTS = "comment_id string, video_id string, channel_id string, author string, text string, like_count long, published_at string, pulled_at string"
CLEAN_CORPUS = "comment_id string, video_id string, source_file string, text string, n_tokens int, screen_kk int, screen_ru int, screen_bucket string, density_eligible boolean, like_count long, published_at string"
OTHER_LANGUAGE = "comment_id string, video_id string, text string, language string"
SHEET = "comment_id string, text string, sentiment string, density string, base_lang string, notes string"
MANIFEST = "comment_id string, batch string, sample string, stratum string, screen_bucket string, video_id string, n_tokens string, density_eligible string, inclusion_prob string"
LABELLED = "comment_id string, text string, sentiment string, density string, base_lang string, notes string, video_id string, n_tokens string, density_eligible string, sample string, screen_bucket string, inclusion_prob string"
FOLDS = "seed int, k int, test_share double, n_labeled int, folds array<array<string>>, test array<string>"
PREDICTIONS = "comment_id string, gold string, density string, n_tokens string, representation string, classifier string, fold string, pred string"
SOURCES = "name string, search_query string, channel_id string, priority string, category string, measured_mixed_pct string, verified string, note string"
VIDEOS = "video_id string, source_name string, category string, title string, channel_title string, published_at string, comment_count long, view_count long, pulled string"
PROMPT_INDEX = "prompt string, n int, ids array<string>"
