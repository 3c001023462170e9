"""storefront.sources"""
