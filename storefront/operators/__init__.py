"""storefront.operators"""
