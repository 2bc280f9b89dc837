"""Training-data operators: decontamination, language, extraction, pieces, scoring, chat, tokens, quality, near copies, archives."""
