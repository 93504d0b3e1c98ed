"""DataFrame operators: encode, decode, chat, special tokens, batches."""
