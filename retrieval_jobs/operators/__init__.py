"""DataFrame operators; every question-side operator takes many questions at once, by query_id."""
