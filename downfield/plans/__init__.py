"""Building the stored tables and answering questions over them."""
