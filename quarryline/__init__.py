"""DataFrame jobs for web-page corpora, interaction events and training-data preparation."""
