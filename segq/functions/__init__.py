"""segq subpackage."""
