"""Training-data operators over the library's text records: claims, facility readings and their notices."""
