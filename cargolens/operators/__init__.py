"""The analytical operators. Every one maps frames to a lazy frame."""
