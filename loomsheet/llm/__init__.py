"""Text preparation for language-model training; nothing else in the engine imports it."""
